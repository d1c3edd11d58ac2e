"""Filters and rankings over an assignment table.

``assignments(target, overlay, is_entity, texture, ...)`` has one row per target and
``faces(texture, overlay, ...)`` one row per entity texture and region. Faces are matched
per texture, not per target, so the work on them does not grow with the targets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ringloom.functions.paths import file_name, lower_contains
from ringloom.operators import matching, sizing

CHAINED = 32  # patterns that are searched one by one

# Preview priority, best first.
PRIORITY_PATTERNS = (
    "grass_block_top",
    "stone",
    "dirt",
    "sand",
    "gravel",
    "oak_planks",
    "cobblestone",
    "water_still",
    "lava_still",
    "pack.png",
    "pack.mcmeta",
)


def of_kind(assignments: DataFrame, kind: str) -> DataFrame:
    if kind not in ("all", "entity", "regular"):
        raise ValueError(f"unknown kind: {kind}")
    if kind == "all":
        return assignments
    return assignments.filter(F.col("is_entity") if kind == "entity" else ~F.col("is_entity"))


def _own_or_face(
    assignments: DataFrame, faces: DataFrame, own: Column, face: Column, faces_small: bool
) -> DataFrame:
    """Targets with a hit of their own or on any face, in one pass over the targets."""
    hits = faces.filter(face).select("texture").distinct().withColumn("_face_hit", F.lit(True))
    marked = sizing.join_left(assignments, hits, "texture", faces_small)
    hit = F.coalesce(own, F.lit(False)) | F.coalesce("_face_hit", F.lit(False))
    return marked.filter(hit).select(*assignments.columns)


def text_filter(
    assignments: DataFrame, faces: DataFrame, text: str, faces_small: bool = False
) -> DataFrame:
    """Case-insensitive substring on the target, its overlay, or any face overlay.

    ``faces_small``: the catalogue's textures were measured to fit a broadcast.
    """
    if not text.strip():
        return assignments
    own = lower_contains(F.col("target"), text) | lower_contains(F.col("overlay"), text)
    return _own_or_face(assignments, faces, own, lower_contains(F.col("overlay"), text), faces_small)


def reverse_lookup(
    assignments: DataFrame, faces: DataFrame, query: str, exact: bool = False, faces_small: bool = False
) -> DataFrame:
    """Targets whose overlay, or any face overlay, has a matching file name."""
    wanted = query.strip().lower()
    if not wanted:
        return assignments.limit(0)
    name = F.lower(file_name(F.col("overlay")))
    hit = (name == wanted) if exact else F.contains(name, F.lit(wanted))
    return _own_or_face(assignments, faces, hit, hit, faces_small)


def priority_score(path: Column, patterns: tuple[str, ...] = PRIORITY_PATTERNS) -> Column:
    """Index of the first pattern the lower-cased path contains, else their number."""
    lowered = F.lower(path)
    chain = None
    for rank, pattern in enumerate(patterns):
        hit = F.contains(lowered, F.lit(pattern))
        chain = F.when(hit, rank) if chain is None else chain.when(hit, rank)
    return F.lit(0) if chain is None else chain.otherwise(len(patterns))


def with_priority(rows: DataFrame, path: str, patterns: tuple[str, ...] = PRIORITY_PATTERNS) -> DataFrame:
    """``rows`` plus ``score``; a long list of patterns costs one pass of the path, not one each."""
    if len(patterns) <= CHAINED:
        return rows.withColumn("score", priority_score(F.col(path), patterns))
    found = matching.with_hits(rows.withColumn("_lowered", F.lower(path)), "_lowered", list(patterns), "_first")
    score = F.coalesce(F.get("_first", F.lit(0)), F.lit(len(patterns)))
    return found.withColumn("score", score).drop("_lowered", "_first")


def priority_top(
    assignments: DataFrame,
    order: str | list[str],
    count: int = 200,
    patterns: tuple[str, ...] = PRIORITY_PATTERNS,
) -> DataFrame:
    """The first ``count`` rows by (score, ``order``): per-task top-k, then one merge."""
    order = [order] if isinstance(order, str) else order
    scored = with_priority(assignments, "target", patterns)
    return scored.orderBy("score", *order).limit(count)
