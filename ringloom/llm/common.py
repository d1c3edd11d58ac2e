"""What several operators of this subpackage need."""

from __future__ import annotations

from collections.abc import Iterator
from zlib import crc32

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ringloom.operators.lineage import cut_lineage

__all__ = ["ascii_lower", "cut_lineage", "digest_of", "held_out", "running_total", "slices", "table", "text_key"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def text_key(text: Column) -> Column:
    """Tells rows that share an id apart; null texts have one key of their own."""
    return F.coalesce(F.xxhash64(text, F.length(text)), F.lit(0))


def held_out(doc_id: Column) -> Column:
    """The fold that is never learned from. A row without an id can't be drawn: it is held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def is_held_out(doc_id: int) -> bool:
    return crc32(str(doc_id).encode()) % 5 == 0


def digest_of(parts: Column) -> Column:
    """SHA-256, in lower-case hex, of an array of strings joined by commas."""
    return F.sha2(F.array_join(F.coalesce(parts, F.array().cast("array<string>")), ",").cast("binary"), 256)


def running_total(df: DataFrame, keys: list[str], bucket: str, order: list, value: Column, name: str) -> DataFrame:
    """Sum of ``value`` over the rows of ``keys`` that come before, by (bucket, order).

    Two levels: sums per bucket run over the buckets, rows over their own bucket, so that with
    about as many buckets as rows in a bucket no task orders more than the square root of a
    group.
    """
    per_bucket = df.groupBy(*keys, bucket).agg(F.sum(value).alias("_in_bucket"))
    over_buckets = Window.partitionBy(*keys).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    starts = per_bucket.select(
        *keys, bucket, F.coalesce(F.sum("_in_bucket").over(over_buckets), F.lit(0)).alias("_start")
    )
    inside = Window.partitionBy(*keys, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return (
        df.join(starts, [*keys, bucket])
        .withColumn(name, F.col("_start") + F.coalesce(F.sum(value).over(inside), F.lit(0)))
        .drop("_start")
    )


def slices(n: int, width: int) -> Iterator[tuple[int, int]]:
    """Bounds of consecutive pieces."""
    for start in range(0, n, width):
        yield start, min(n, start + width)
