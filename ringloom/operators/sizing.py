"""Measured sizes: what may be broadcast, and how hot keys are spread.

Nothing here guesses from plan statistics. A side is broadcast only after its rows and
bytes were counted by a job that reads just the columns in question; otherwise the
caller takes its shuffle path.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BROADCAST_MAX_BYTES = 64 << 20
BROADCAST_MAX_ROWS = 1_000_000
ROW_OVERHEAD_BYTES = 16


@dataclass(frozen=True)
class Size:
    """Rows, total bytes and the widest row of a table (strings, arrays: as stored or as JSON)."""

    rows: int
    bytes: int
    widest: int = 0

    def widened(self, extra: int) -> Size:
        """The same rows with up to ``extra`` more bytes each."""
        return Size(self.rows, self.bytes + self.rows * extra, self.widest + extra)

    def fits(self, max_bytes: int | None = None, max_rows: int | None = None, copies: int = 1) -> bool:
        """Whether ``copies`` joins of one stage may each hold the table."""
        max_bytes = BROADCAST_MAX_BYTES if max_bytes is None else max_bytes
        max_rows = BROADCAST_MAX_ROWS if max_rows is None else max_rows
        return self.rows * copies <= max_rows and self.bytes * copies <= max_bytes


def _row_width(df: DataFrame) -> str:
    parts = [str(ROW_OVERHEAD_BYTES)]
    for name, kind in df.dtypes:
        if kind in ("string", "binary"):
            parts.append(f"coalesce(octet_length(`{name}`), 0)")
        elif kind.startswith(("array", "map", "struct")):
            parts.append(f"coalesce(octet_length(to_json(struct(`{name}`))), 0)")
        else:
            parts.append("8")
    return f"CAST({' + '.join(parts)} AS BIGINT)"


def size_row(df: DataFrame, *extra: Column) -> DataFrame:
    """One row ``(n, b, w, *extra)``, partially aggregated."""
    width = F.expr(_row_width(df))
    zero = F.lit(0)
    return df.agg(
        F.count(F.lit(1)).alias("n"),
        F.coalesce(F.sum(width), zero).alias("b"),
        F.coalesce(F.max(width), zero).alias("w"),
        *extra,
    )


def measure(df: DataFrame) -> Size:
    row = size_row(df).first()
    return Size(row["n"], row["b"], row["w"])


def broadcast_if_small(df: DataFrame, max_bytes: int | None = None) -> DataFrame:
    """``df`` with a broadcast hint if it was measured to fit, else unchanged.

    For tables that are given or cheap to recompute, in plain equi-joins: without the hint
    Spark shuffles on the key and adaptive execution splits skewed partitions. Sides that are
    themselves results of joins are left unhinted; adaptive execution broadcasts them if
    their shuffled size turns out small.
    """
    return F.broadcast(df) if measure(df).fits(max_bytes) else df


def hinted(df: DataFrame, small: bool) -> DataFrame:
    """``df`` broadcast if it is ``small``, else in a sorted merge, which spills.

    Without a hint Spark would still broadcast a side that its own estimate, made before joins and
    aggregates have run, takes for small; that side grows with the data.
    """
    return F.broadcast(df) if small else df.hint("merge")


def join_left(df: DataFrame, other: DataFrame, key: str, small: bool) -> DataFrame:
    """Left equi-join on the string column ``key``; ``other`` is broadcast if it is ``small``, else
    never, whatever Spark estimates.

    In a shuffle all rows without a key would meet in one task. They get keys of their own
    instead, which begin with a character that no path or name has.
    """
    if small:
        return df.join(F.broadcast(other), key, "left")
    row = [F.col(f"`{c}`") for c, kind in df.dtypes if kind != "binary"]
    alone = F.concat(F.lit("\0"), F.xxhash64(*row).cast("string"))
    spread = df.withColumn("_spread", F.coalesce(key, alone))
    return spread.join(hinted(other.withColumnRenamed(key, "_spread"), False), "_spread", "left").drop("_spread")


def salt_hot_keys(
    many: DataFrame,
    one: DataFrame,
    key: str,
    spread_by: list[str],
    rows_per_salt: int,
) -> tuple[DataFrame, DataFrame]:
    """Add a ``salt`` column to both sides of a join so that no key is one task.

    Keys of ``many`` with more than ``rows_per_salt`` rows are spread over
    ``ceil(rows / rows_per_salt)`` salts and their row of ``one`` is repeated that often;
    all other keys keep the single salt 0. Counts are partially aggregated. The hot keys are
    broadcast if they are measured to fit, else joined in a shuffle. The salt is a function of
    ``spread_by`` columns, so a recomputed task repeats its assignment.
    """
    counts = many.groupBy(key).agg(F.count(F.lit(1)).alias("key_rows"))
    hot = counts.filter(F.col("key_rows") > rows_per_salt).select(
        key, F.ceil(F.col("key_rows") / F.lit(rows_per_salt)).cast("int").alias("salts")
    )
    hot = broadcast_if_small(hot)
    salts = F.coalesce(F.col("salts"), F.lit(1))
    salted_many = (
        many.join(hot, key, "left")
        .withColumn("salt", F.pmod(F.xxhash64(*spread_by), salts).cast("int"))
        .drop("salts")
    )
    salted_one = (
        one.join(hot, key, "left")
        .withColumn("salt", F.explode(F.sequence(F.lit(0), salts - 1)))
        .drop("salts")
    )
    return salted_many, salted_one
