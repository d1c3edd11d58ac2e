"""Assigning sources to targets, animation frames and entity regions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ringloom.functions.hashing import (
    batched_position,
    batched_state,
    hash_final,
    hash_state,
    ring_position,
    target_state,
)
from ringloom.operators.catalog import Catalogue, hinted, texture_owners
from ringloom.operators.ring import Ring, look_up

FACE_MODES = ("same", "different")
TEXTURE_MODES = ("shared", "separate")


def target_position(targets: DataFrame, seed: int, rel: str = "rel") -> Column:
    """Ring position of each target.

    Hashed in Arrow batches, except for rows that carry rasters: those would be copied past
    the Python worker for the sake of one number.
    """
    carries_pixels = any(kind == "binary" for _, kind in targets.dtypes)
    return (ring_position if carries_pixels else batched_position)(rel, target_state(seed))


def assign_targets(targets: DataFrame, ring: Ring, seed: int, rel: str = "rel") -> DataFrame:
    """``targets`` plus ``overlay``; the key is ``{seed}:{rel}``."""
    keyed = targets.withColumn("pos", target_position(targets, seed, rel))
    return look_up(keyed, ring).drop("pos")


def assign_frames(
    targets: DataFrame, ring: Ring, seed: int, per_frame: bool = True, rel: str = "rel"
) -> DataFrame:
    """``targets(..., frames)`` exploded to one row per frame, plus ``overlay``.

    Frame 0, and every frame when ``per_frame`` is off, keeps the target's own key; frame
    ``f`` appends ``:{f}``. The path is hashed once per target, the tail once per frame.
    """
    state = targets.withColumn("state", batched_state(rel, target_state(seed)))
    frames = state.withColumn("frame", F.explode(F.sequence(F.lit(0), F.col("frames") - 1)))
    tail = "IF(frame = 0, '', concat(':', frame))" if per_frame else "''"
    keyed = frames.withColumn("tail", F.expr(tail)).withColumn("pos", ring_position("tail", "state"))
    return look_up(keyed.drop("state", "tail"), ring).drop("pos")


def _extended(state: str, part: str) -> Column:
    return hash_state(f"concat(':', {part})", state)


def assign_entities(
    catalogue: Catalogue,
    ring: Ring,
    seed: int,
    face_mode: str = "same",
    texture_mode: str = "shared",
) -> DataFrame:
    """``(texture, entity_id, region_ord, region, overlay)`` for every owned texture.

    The key is ``{seed}:{entity}``, plus ``:{texture}`` when textures are separate, plus
    ``:{region}`` when faces differ. Each key part is hashed at the coarsest table that has
    it, and the ring is probed once per distinct key before rows fan out to regions.
    """
    if face_mode not in FACE_MODES:
        raise ValueError(f"Invalid face_mode: {face_mode}")
    if texture_mode not in TEXTURE_MODES:
        raise ValueError(f"Invalid texture_mode: {texture_mode}")
    fits = catalogue.profile.fits
    owners = texture_owners(catalogue)
    regions = hinted(
        catalogue.regions.select(
            "entity_id", F.col("ord").alias("region_ord"), F.col("name").alias("region")
        ),
        fits("regions"),
    )
    entities = catalogue.entities.select(
        "entity_id", hash_state("entity_id", target_state(seed)).alias("state")
    )
    if texture_mode == "separate":
        keyed = owners.join(hinted(entities, fits("entities")), "entity_id")
        keyed = keyed.withColumn("state", _extended("state", "texture"))
    else:
        keyed = entities
    if face_mode == "different":
        keyed = keyed.join(regions, "entity_id").withColumn("state", _extended("state", "region"))
    placed = look_up(keyed.withColumn("pos", hash_final("state")).drop("state"), ring).drop("pos")
    if texture_mode == "shared":
        # One row per entity, or per entity and region.
        small = fits("entities", "regions", extra=ring.sources.widest)
        placed = owners.join(hinted(placed, small), "entity_id")
    if face_mode == "same":
        placed = placed.join(regions, "entity_id")
    return placed.select("texture", "entity_id", "region_ord", "region", "overlay")


def primary_overlays(faces: DataFrame, key: list[str]) -> DataFrame:
    """Per target: the first face's overlay, and the name to display.

    The display name is the one overlay if all faces agree, else ``[multiple]``.
    """
    return faces.groupBy(*key).agg(
        F.min_by("overlay", "region_ord").alias("overlay"),
        F.when(F.min("overlay") == F.max("overlay"), F.min("overlay"))
        .otherwise(F.lit("[multiple]"))
        .alias("display"),
    )
