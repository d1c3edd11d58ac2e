"""Splitting targets into entity textures and regular ones."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ringloom.functions.paths import normalise
from ringloom.operators.affix import joins_of, longest_affix
from ringloom.operators.catalog import Profile


def classify_targets(
    targets: DataFrame, owners: DataFrame, profile: Profile | None = None
) -> DataFrame:
    """``targets(target, ...)`` plus ``texture``, ``entity_id`` and ``is_entity``.

    A target is an entity texture if its path ends with a catalogue texture path. There is
    no folder-boundary check; of several matches the longest wins. ``profile`` is that of the catalogue the owners
    come from.
    """
    patterns = (
        owners.withColumn("_norm", normalise(F.col("texture")))
        .groupBy("_norm")
        .agg(F.max_by(F.struct("texture", "entity_id"), F.struct("texture", "entity_id")).alias("_o"))
        .select("_norm", "_o.texture", "_o.entity_id")
    )
    probe = targets.withColumn("_path", normalise(F.col("target")))
    known, bound = (None, None), None
    if profile:
        bound = profile.max_broadcast_bytes
        lengths = profile.texture_lengths
        known = profile.fits("textures", copies=joins_of(lengths[1])), lengths
    matched = longest_affix(probe, "_path", patterns, "_norm", "suffix", "target", *known, bound)
    return matched.drop("_path", "_norm").withColumn("is_entity", F.col("entity_id").isNotNull())


def classification_totals(classified: DataFrame) -> DataFrame:
    return classified.agg(
        F.count(F.lit(1)).alias("targets"),
        F.count_if("is_entity").alias("entity_targets"),
        F.count_if(~F.col("is_entity")).alias("regular_targets"),
    )
