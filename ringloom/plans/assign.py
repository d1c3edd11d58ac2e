"""The full assignment: classify targets, place regular and entity ones, unite."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ringloom.functions.geometry import frame_count
from ringloom.operators import sizing
from ringloom.operators.assign import (
    assign_entities,
    assign_frames,
    assign_targets,
    primary_overlays,
    target_position,
)
from ringloom.operators.catalog import Catalogue, texture_owners
from ringloom.operators.classify import classify_targets
from ringloom.operators.ring import Ring, look_up, prepare_ring
from ringloom.operators.search import PRIORITY_PATTERNS, of_kind, priority_top, text_filter


@dataclass(frozen=True)
class Assignments:
    """``targets``: one row per target with its primary overlay, kind, entity, canonical size
    and display name. ``faces``: one row per entity texture and region; ``faces_of`` spreads
    them to targets."""

    targets: DataFrame
    faces: DataFrame
    faces_fit: Callable[[], bool] = lambda: False
    textures_fit: bool = False

    def target_faces(self) -> DataFrame:
        """``(target, entity_id, region_ord, region, overlay)`` for entity targets."""
        owners = self.targets.filter("is_entity").select("target", "texture")
        return owners.join(sizing.hinted(self.faces, self.faces_fit()), "texture").drop("texture")


def require_rows(df: DataFrame, what: str) -> None:
    if df.isEmpty():
        raise ValueError(f"No {what} found")


def build_assignments(
    sources: DataFrame,
    targets: DataFrame,
    catalogue: Catalogue | None,
    seed: int,
    face_mode: str = "same",
    texture_mode: str = "shared",
    ring: Ring | None = None,
    keep: tuple[str, ...] = (),
    checked: bool = False,
) -> Assignments:
    """Assign ``sources(source, rel)`` to ``targets(target, rel)``.

    With a ring and a catalogue of broadcast size the targets are read once and never
    shuffled. ``keep`` names further target columns to carry along. The bounds of broadcasts are
    those of the ring and of the catalogue (``max_broadcast_bytes`` of either). ``checked`` says that
    there are targets, which is not looked for again.
    """
    ring = ring or prepare_ring(sources, seed)
    if ring.sources.rows == 0:
        raise ValueError("No overlay images found")
    if not checked:
        require_rows(targets, "texture images")
    kinds = ["target", "rel", "overlay", "is_entity", "entity_id", "texture", "tex_w", "tex_h", "display", *keep]
    if catalogue is None:
        placed = assign_targets(targets, ring, seed)
        return Assignments(
            placed.select(
                "target",
                "rel",
                "overlay",
                F.lit(False).alias("is_entity"),
                *[F.lit(None).cast(t).alias(c) for c, t in (("entity_id", "string"), ("texture", "string"), ("tex_w", "int"), ("tex_h", "int"))],
                F.col("overlay").alias("display"),
                *keep,
            ),
            placed.select(
                F.lit(None).cast("string").alias("texture"),
                F.lit(None).cast("string").alias("entity_id"),
                F.lit(None).cast("bigint").alias("region_ord"),
                F.lit(None).cast("string").alias("region"),
                "overlay",
            ).limit(0),
        )
    fits = catalogue.profile.fits
    classified = classify_targets(targets, texture_owners(catalogue), catalogue.profile)
    faces = assign_entities(catalogue, ring, seed, face_mode, texture_mode)
    # One pass: a regular target has a ring position, an entity one a texture; each join
    # leaves the other kind's columns null.
    position = F.when(~F.col("is_entity"), target_position(targets, seed))
    placed = look_up(classified.withColumn("pos", position), ring)
    summary = primary_overlays(faces, ["texture"]).withColumnRenamed("overlay", "face_overlay")
    sizes = catalogue.entities.select("entity_id", "tex_w", "tex_h")
    # One row per texture, with two source names added.
    small = fits("textures", extra=2 * ring.sources.widest)
    joined = sizing.join_left(placed, summary, "texture", small)
    joined = sizing.join_left(joined, sizes, "entity_id", fits("entities"))
    # An entity without regions shows the first source.
    entity_overlay = F.coalesce(F.col("face_overlay"), F.lit(ring.first_source))
    named = joined.withColumn("overlay", F.when(F.col("is_entity"), entity_overlay).otherwise(F.col("overlay")))
    shown = F.when(F.col("is_entity"), F.coalesce("display", F.lit("[multiple]"))).otherwise(F.col("overlay"))
    pair_bytes = catalogue.profile.textures.widest + catalogue.profile.regions.widest + ring.sources.widest

    def faces_fit() -> bool:
        return sizing.Size(catalogue.face_rows, catalogue.face_rows * pair_bytes).fits(catalogue.max_broadcast_bytes)

    return Assignments(named.withColumn("display", shown).select(*kinds), faces, faces_fit, fits("textures"))


def preview_list(
    built: Assignments,
    kind: str = "all",
    text: str = "",
    count: int = 200,
    patterns: tuple[str, ...] = PRIORITY_PATTERNS,
) -> DataFrame:
    """The first ``count`` assignments of a kind that match a text, by priority.

    Within one score regular targets come first, then by path.
    """
    shown = text_filter(of_kind(built.targets, kind), built.faces, text, built.textures_fit)
    return priority_top(shown, ["is_entity", "target"], count, patterns)


def zip_faces(nested: DataFrame) -> DataFrame:
    """Long form of ``nested(target, regions array, overlays array)``: paired position by
    position, to the shorter length."""
    shorter = F.least(F.size("regions"), F.size("overlays"))
    paired = F.arrays_zip(
        F.slice("regions", F.lit(1), shorter).alias("region"), F.slice("overlays", F.lit(1), shorter).alias("overlay")
    )
    flat = nested.select("target", F.posexplode(paired).alias("region_ord", "pair"))
    return flat.select("target", "region_ord", "pair.region", "pair.overlay")


def frame_assignments(
    targets: DataFrame, sidecars: DataFrame, ring: Ring, seed: int, per_frame: bool = True
) -> DataFrame:
    """One row per regular target and frame.

    ``targets(target, rel, w, h)``; ``sidecars(path, has_anim)`` are matched on
    ``{target}.mcmeta``.
    """
    beside = sizing.broadcast_if_small(
        sidecars.select(F.regexp_replace("path", r"\.mcmeta$", "").alias("target"), "has_anim")
    )
    counted = targets.join(beside, "target", "left").withColumn(
        "frames", frame_count(F.col("w"), F.col("h"), F.col("has_anim"))
    )
    return assign_frames(counted.drop("has_anim"), ring, seed, per_frame)
