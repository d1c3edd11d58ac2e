"""Consistent-hash ring: build, interval form, and the forward as-of lookup.

A key takes the first ring entry at or after its position, or the smallest entry when it
lies past the end. As intervals: entry ``i`` owns ``[pos[i-1] + 1, pos[i]]`` and the
smallest entry also owns ``[pos[last] + 1, 2**32 - 1]``. The intervals tile the position
space, so the lookup is an equi-join on a position bucket plus a range residual. There are
about as many buckets as entries, so a key meets O(1) intervals.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ringloom.functions.hashing import MASK32, ring_position, source_state
from ringloom.operators import sizing

MAX_BUCKET_BITS = 31
SEGMENT_BITS = 12


def build_ring(sources: DataFrame, seed: int | None, by: tuple[str, ...] = ()) -> DataFrame:
    """Ring ``(*by, pos, source)`` from ``sources(source, rel)``; ties go to the smallest source.

    With ``seed=None`` the sources carry a ``source_head`` state column (one ring per ``by``
    group, e.g. per candidate seed).
    """
    head = "source_head" if seed is None else source_state(seed)
    keyed = sources.select(*by, ring_position("rel", head).alias("pos"), "source")
    return keyed.groupBy(*by, "pos").agg(F.min("source").alias("source"))


@dataclass(frozen=True)
class Ring:
    """Interval form of a ring, ready for lookups."""

    intervals: DataFrame  # (*by, lo, hi, source)
    by: tuple[str, ...]
    bucket_bits: int
    broadcastable: bool
    sources: sizing.Size
    first_source: str | None


def _adjacent(ring: DataFrame, by: tuple[str, ...]) -> DataFrame:
    keys = ", ".join(by)
    over = f"({'PARTITION BY ' + keys if by else ''} ORDER BY pos"
    near = ring.selectExpr(
        *by,
        "source",
        "pos AS hi",
        f"lag(pos) OVER {over}) AS previous",
        f"max(pos) OVER {over} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS last",
    )
    own = "struct(coalesce(previous, -1L) + 1 AS lo, hi AS hi)"
    wrap = f"struct(last + 1 AS lo, {MASK32}L AS hi)"
    arcs = f"inline(IF(previous IS NULL, array({own}, {wrap}), array({own})))"
    return near.selectExpr(*by, "source", arcs).filter("lo <= hi").select(*by, "lo", "hi", "source")


def _adjacent_by_segment(ring: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """Same intervals without one task holding the ring.

    Neighbours are found inside 2**12 position segments; only the first entry of a segment
    needs the last position of the nearest filled segment before it, taken from a summary of
    at most 2**12 rows per ring.
    """
    segmented = ring.withColumn("segment", F.shiftright("pos", 32 - SEGMENT_BITS).cast("int"))
    summary = segmented.groupBy(*by, "segment").agg(
        F.max("pos").alias("seg_max"), F.min_by("source", "pos").alias("seg_first")
    )
    across = Window.partitionBy(*by).orderBy("segment") if by else Window.orderBy("segment")
    heads = summary.select(
        *by,
        "segment",
        F.lag("seg_max").over(across).alias("before"),
    )
    if not by:
        heads = F.broadcast(heads)
    inside = Window.partitionBy(*by, "segment").orderBy("pos")
    own = (
        segmented.withColumn("previous", F.lag("pos").over(inside))
        .join(heads, [*by, "segment"])
        .select(
            *by,
            (F.coalesce("previous", "before", F.lit(-1)) + 1).alias("lo"),
            F.col("pos").alias("hi"),
            "source",
        )
    )
    wrap = (
        summary.groupBy(*by)
        .agg((F.max("seg_max") + 1).alias("lo"), F.min_by("seg_first", "seg_max").alias("source"))
        .select(*by, "lo", F.lit(MASK32).alias("hi"), "source")
        .filter("lo <= hi")
    )
    return own.unionByName(wrap)


def prepare_ring(
    sources: DataFrame,
    seed: int | None,
    by: tuple[str, ...] = (),
    rings: int = 1,
    max_broadcast_bytes: int | None = None,
) -> Ring:
    """Measure the sources, then lay the ring out for its size.

    ``rings`` is the number of ``by`` groups; buckets are sized for one of them.
    """
    found = sizing.size_row(sources.select("source"), F.min("source").alias("first")).first()
    size = sizing.Size(found["n"], found["b"], found["w"])
    # What is broadcast has three numbers beside the source, and about two rows for each.
    small = size.widened(24).fits(max_broadcast_bytes, copies=2)
    layout = _adjacent if small else _adjacent_by_segment
    bits = (max(size.rows // rings, 2) - 1).bit_length()
    return Ring(layout(build_ring(sources, seed, by), by), by, min(bits, MAX_BUCKET_BITS), small, size, found["first"])


def look_up(keys: DataFrame, ring: Ring, pos: str = "pos", out: str = "overlay") -> DataFrame:
    """As-of join: ``keys`` plus ``out``, null only when the ring is empty.

    Small ring: map-only, the bucketed intervals are broadcast and ``keys`` is not
    shuffled. Large ring: shuffled on the bucket, of which there are as many as entries.
    Positions are hashes, so only repeated keys make a bucket hot; adaptive execution splits
    those. A key without a position gets a bucket of its own that no interval has.
    """
    shift = 32 - ring.bucket_bits
    on = [*ring.by, "bucket"]
    arcs = ring.intervals.selectExpr(
        *ring.by,
        "lo",
        "hi",
        f"source AS `{out}`",
        f"explode(sequence(shiftright(lo, {shift}), shiftright(hi, {shift}))) AS bucket",
    )
    probe = keys.selectExpr("*", f"shiftright({pos}, {shift}) AS bucket")
    arcs = sizing.hinted(arcs, ring.broadcastable)
    if not ring.broadcastable:
        row = ", ".join(f"`{c}`" for c, kind in keys.dtypes if kind != "binary")
        alone = f"-1L - pmod(xxhash64({row}), {MASK32}L)"
        probe = keys.selectExpr("*", f"coalesce(shiftright({pos}, {shift}), {alone}) AS bucket")
    match = " AND ".join([*(f"p.{c} = a.{c}" for c in on), f"p.{pos} >= a.lo", f"p.{pos} <= a.hi"])
    joined = probe.alias("p").join(arcs.alias("a"), F.expr(match), "left")
    return joined.selectExpr(*(f"p.`{c}`" for c in keys.columns), f"a.`{out}`")
