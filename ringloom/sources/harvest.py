"""Harvesting texture paths from a text corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ringloom.operators.catalog import keep_first


def harvest_paths(corpus: DataFrame, text: str, pattern: str, prefix: str, key: list[str], order: str) -> DataFrame:
    """``(*key, at, texture)``: distinct captures per key in first-seen order.

    Group 1 of ``pattern`` is taken from the whole of ``text``; documents of one key go by
    ``order``. ``at`` is ``(document, position)``.
    """
    found = corpus.select(
        *key,
        F.col(order).alias("_doc"),
        F.posexplode(F.regexp_extract_all(text, F.lit(pattern), F.lit(1))).alias("_pos", "_hit"),
    ).select(
        *key, F.struct("_doc", "_pos").alias("at"), F.concat(F.lit(prefix), F.col("_hit")).alias("texture")
    )
    return keep_first(found, [*key, "texture"], "at")
