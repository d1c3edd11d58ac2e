"""Longest-affix matching: prefix rules and suffix catalogues without a nested loop.

A pattern of length ``l`` is a suffix of a text iff it equals the text's last ``l``
characters. So the theta join becomes equi-joins on the text's cuts at the pattern lengths
that occur. All patterns share a minimum length ``k``; a first equi-join on the
``k``-character cut gives the lengths worth trying, so a text that cannot match is never
probed again. Lengths are then probed longest first, each probe a map-side join against the
same broadcast table, which must fit once for each. Only texts with very many candidate
lengths, or a pattern table too large to broadcast, are expanded and reduced to their longest
match instead; then only the lengths per cut are broadcast, if they fit, and nothing that Spark
merely estimates to be small.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ringloom.operators import sizing

MAX_PROBES = 8


def length_stats(pattern: str) -> list[Column]:
    """Aggregates: least positive length and number of distinct positive lengths."""
    length = F.nullif(F.length(pattern), F.lit(0))
    return [F.min(length).alias("shortest"), F.count_distinct(length).alias("lengths")]


def joins_of(lengths: int) -> int:
    """Joins of one stage that hold the patterns, if those are broadcast: a task has a table for
    each, so the patterns must fit as often."""
    return min(lengths, MAX_PROBES) + 1


def longest_affix(
    texts: DataFrame,
    text: str,
    patterns: DataFrame,
    pattern: str,
    side: str,
    key: str,
    small: bool | None = None,
    lengths_known: tuple[int | None, int] | None = None,
    max_broadcast_bytes: int | None = None,
) -> DataFrame:
    """``texts`` plus the columns of its longest matching pattern row (null if none).

    ``patterns[pattern]`` must be unique; empty patterns never match. ``key`` identifies a
    row of ``texts``. ``small`` says whether the patterns were already measured to fit
    ``joins_of`` broadcasts, ``lengths_known`` gives their least length and number of distinct lengths
    (those of a superset will do).
    """
    if side not in ("prefix", "suffix"):
        raise ValueError(f"unknown side: {side}")

    def cut(c: Column, n: Column) -> Column:
        if side == "suffix":
            return F.substring(c, F.greatest(F.length(c) - n, F.lit(0)) + 1, n)
        return F.substring(c, F.lit(1), n)

    payload = [c for c in patterns.columns if c != pattern]
    rows = patterns.filter(F.length(pattern) > 0)
    if small is None or lengths_known is None:
        found = sizing.size_row(rows, *length_stats(pattern)).first()
        lengths_known = found["shortest"], found["lengths"]
        if small is None:
            small = sizing.Size(found["n"], found["b"]).fits(max_broadcast_bytes, copies=joins_of(found["lengths"]))
    shortest, most = lengths_known
    if shortest is None:
        return texts.select("*", *[F.lit(None).cast(t).alias(n) for n, t in patterns.dtypes])

    stem = F.lit(shortest)
    lengths = rows.groupBy(cut(F.col(pattern), stem).alias("_stem")).agg(
        # Distinct lengths, so bounded by the longest pattern.
        F.sort_array(F.collect_set(F.length(pattern)), asc=False).alias("_lengths")
    )
    stems_small = small
    if most > MAX_PROBES or not small:
        # Many lengths overall may still be few per cut, many patterns may have few cuts.
        stems = sizing.size_row(lengths, F.max(F.size("_lengths")).alias("most")).first()
        stems_small = small or sizing.Size(stems["n"], stems["b"]).fits(max_broadcast_bytes, copies=2)
        most = stems["most"]
    probes = min(most, MAX_PROBES) if small else 1
    own = list(texts.columns)
    table = rows.select(F.col(pattern).alias("_cut"), F.struct(pattern, *payload).alias("_row"))
    probe = texts.withColumn("_stem", F.when(F.length(text) >= stem, cut(F.col(text), stem)))
    probe = sizing.join_left(probe, lengths, "_stem", stems_small).drop("_stem")

    def finished(df: DataFrame) -> DataFrame:
        return df.select(*own, *[F.col(f"_best.{c}").alias(c) for c in (pattern, *payload)])

    few = probe if most <= probes else probe.filter(F.coalesce(F.size("_lengths"), F.lit(0)) <= probes)
    for i in range(probes):
        at = cut(F.col(text), F.get("_lengths", F.lit(i)))
        if i:
            at = F.when(F.col("_best").isNull(), at)
        few = sizing.join_left(few.withColumn("_cut", at), table, "_cut", small).drop("_cut")
        best = F.coalesce("_best", "_row") if i else F.col("_row")
        few = few.withColumn("_best", best).drop("_row")
    if most <= probes:
        return finished(few)
    several = probe.filter(F.size("_lengths") > probes)
    hits = (
        several.select(key, text, F.explode("_lengths").alias("_n"))
        .filter(F.length(text) >= F.col("_n"))
        .select(key, "_n", cut(F.col(text), F.col("_n")).alias("_cut"))
        .join(sizing.hinted(table, small), "_cut")
        .groupBy(key)
        .agg(F.max_by("_row", "_n").alias("_best"))
    )
    return finished(few).unionByName(finished(several.join(sizing.hinted(hits, False), key, "left")))
