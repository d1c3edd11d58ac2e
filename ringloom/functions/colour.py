"""Colour arithmetic in the 32-bit float steps the blend is defined in."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def blend_weight(source_alpha: Column, alpha: float | Column) -> Column:
    """``a_src * (alpha / 255)`` in float; Spark divides floats as double, hence the cast."""
    level = F.lit(alpha) if isinstance(alpha, float) else alpha
    unit = (level.cast("float") / F.lit(255.0).cast("float")).cast("float")
    return (source_alpha.cast("float") * unit).cast("float")


def blend_channel(base: Column, source: Column, weight: Column) -> Column:
    """``trunc(base * (1 - weight) + source * weight)``; both products rounded to float."""
    inverse = (F.lit(1.0).cast("float") - weight).cast("float")
    kept = (base.cast("float") * inverse).cast("float")
    added = (source.cast("float") * weight).cast("float")
    return (kept + added).cast("float").cast("int")
