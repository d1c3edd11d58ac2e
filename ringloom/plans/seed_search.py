"""Searching a seed range for seeds that satisfy placement constraints.

A seed is accepted if every constraint (text in target path, text in source path) has at
least one matching target that lands on a matching source. A constraint no target matches
rejects every seed. Targets are taken as regular ones (entity textures use other keys).

Two plans give the same rows, and neither shuffles a row for each seed and source:

* small catalogues: the seed range is partitioned; hash states of all sources and constrained
  targets (measured, bounded) travel with the task, which vectorises over seeds;
* otherwise a blocked search for the nearest source. A target lands on a matching source if that is
  nearer, going up the ring, than every other one. So for each block of matching sources and each
  block of the rest, both of broadcast size, tasks keep the (seed, target) pairs of which the matching
  block is still nearer; most pairs leave at the first block. Constraints go by rising number of
  targets, and targets in growing batches, so that a seed that is settled costs no more work.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ringloom.functions.hashing import FACTOR, final_array, hash_state, literal_state
from ringloom.functions.paths import normalise
from ringloom.operators import matching, sizing
from ringloom.operators.lineage import cut_lineage

MAX_TASK_BYTES = 64 << 20
SEEDS_PER_BATCH = 256
CELLS_PER_STEP = 1 << 22  # seeds times sources, or seeds times probes, held at once
BLOCK_BYTES = 32 << 20
BLOCK_ROW_BYTES = 16  # of a source in a block
PROBE_ROW_BYTES = 8
FIRST_TARGETS = 64
CHAINED = 32  # texts that are searched one by one
PAIRS_AT_ONCE = 1 << 20
SORT_PAYS = 24  # targets for which sorting a block costs less than looking through it for each


def _filter_text(text: str) -> str:
    return text.replace("\\", "/").strip().lower()


def _units(text: str) -> Column:
    """Length in UTF-16 code units."""
    return F.expr(f"octet_length(encode({text}, 'UTF-16BE')) div 2")


def _fitting(rows: DataFrame, text: str, filters: list[str], out: str) -> DataFrame:
    """``rows`` plus the places in ``filters`` of those that the lower-cased column holds: a chain of
    searches if they are few, else one pass for all of them."""
    wanted = [_filter_text(f) for f in filters]
    lowered = F.lower(normalise(F.col(text)))
    if len(wanted) > CHAINED:
        return matching.with_hits(rows.withColumn("_lowered", lowered), "_lowered", wanted, out).drop("_lowered")
    hits = [F.when(F.contains(lowered, F.lit(w)), F.lit(i)) for i, w in enumerate(wanted)]
    return rows.withColumn(out, F.filter(F.array(*hits), lambda c: c.isNotNull()))


def constrained_targets(targets: DataFrame, constraints: list[tuple[str, str]]) -> DataFrame:
    """``(cid, rel)``: targets each constraint applies to; an empty filter takes all."""
    fitting = _fitting(targets.select("rel"), "rel", [text for text, _ in constraints], "cids")
    return fitting.select(F.explode("cids").alias("cid"), normalise(F.col("rel")).alias("rel"))


def _powers(units: np.ndarray) -> np.ndarray:
    """31**units modulo 2**32, by squaring."""
    result = np.ones(len(units), np.uint32)
    square = np.uint32(FACTOR)
    left = units.astype(np.int64).copy()
    with np.errstate(over="ignore"):
        while left.any():
            result = np.where(left & 1, result * square, result).astype(np.uint32)
            square = np.uint32(square * square)
            left >>= 1
    return result


def _accepted(
    seeds: np.ndarray,
    source_tail: np.ndarray,
    source_power: np.ndarray,
    qualifies: np.ndarray,
    probes: list[tuple[np.ndarray, np.ndarray]],
) -> np.ndarray:
    """Seeds of one batch that pass; sources come in path order so ties go to the smallest."""
    states = np.array([literal_state(str(s)) for s in seeds], np.uint32)
    n = len(source_tail)
    with np.errstate(over="ignore"):
        ring = final_array(states[:, None] * source_power[None, :] + source_tail[None, :])
    order = np.argsort(ring, axis=1, kind="stable")
    row = np.arange(len(seeds), dtype=np.uint64) << np.uint64(32)
    # One search over all rings: the seed's row number is the high half of the sort key.
    flat = (row[:, None] | np.take_along_axis(ring, order, 1).astype(np.uint64)).ravel()
    alive = np.ones(len(seeds), bool)
    for cid, (tail, power) in enumerate(probes):
        met = np.zeros(len(seeds), bool)
        step = max(1, CELLS_PER_STEP // len(seeds))
        for start in range(0, len(tail), step):
            open_ = np.flatnonzero(alive & ~met)
            if not len(open_):
                break
            part = slice(start, start + step)
            with np.errstate(over="ignore"):
                pos = final_array(states[open_, None] * power[None, part] + tail[None, part])
            at = np.searchsorted(flat, row[open_, None] | pos.astype(np.uint64)) - open_[:, None] * n
            source = np.take_along_axis(order[open_], np.where(at == n, 0, at), 1)
            met[open_] = qualifies[cid][source].any(axis=1)
        alive &= met
    return seeds[alive]


def _search_by_seed(
    spark: SparkSession,
    sources: DataFrame,
    wanted: DataFrame,
    constraints: list[tuple[str, str]],
    seeds: range,
    partitions: int,
) -> DataFrame:
    tail = "concat(':overlay:', rel)"
    held = _fitting(sources, "rel", [text for _, text in constraints], "cids").orderBy("source")
    ring = held.select(hash_state(tail).alias("tail"), _units(tail).alias("units"), "cids").toPandas()
    suffix = "concat(':', rel)"
    probe = wanted.select("cid", hash_state(suffix).alias("tail"), _units(suffix).alias("units")).toPandas()
    qualifies = np.zeros((len(constraints), len(ring)), bool)
    for row, cids in enumerate(ring["cids"]):
        qualifies[cids, row] = True
    source_tail, source_power = ring["tail"].to_numpy(np.uint32), _powers(ring["units"].to_numpy())
    probes = []
    for cid in range(len(constraints)):
        rows = probe[probe["cid"] == cid]
        probes.append((rows["tail"].to_numpy(np.uint32), _powers(rows["units"].to_numpy())))
    shared = spark.sparkContext.broadcast((source_tail, source_power, qualifies, probes))
    together = max(1, min(SEEDS_PER_BATCH, CELLS_PER_STEP // len(ring)))

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        constants = shared.value
        for batch in batches:
            ids = batch["id"].to_numpy(np.int64)
            for start in range(0, len(ids), together):
                yield pd.DataFrame({"seed": _accepted(ids[start : start + together], *constants)})

    return spark.range(seeds.start, seeds.stop, seeds.step, partitions).mapInPandas(search, "seed bigint")


@dataclass(frozen=True)
class Block:
    """Hash states of sources, with their places in the order of paths, which settles ties."""

    tail: np.ndarray
    power: np.ndarray
    place: np.ndarray

    def nearest(self, state: np.ndarray, pos: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(distance, place) of the source that each of a seed's ``pos`` reaches first."""
        with np.errstate(over="ignore"):
            ring = final_array(state * self.power + self.tail)
        if len(pos) < SORT_PAYS:  # a few targets: a look at all sources for each
            found = np.empty(len(pos), np.int64)
            for i, p in enumerate(pos):
                gap = ring - p  # wraps as the ring does
                same = np.flatnonzero(gap == gap.min())
                found[i] = same[np.argmin(self.place[same])]
        else:
            order = np.lexsort((self.place, ring))
            at = np.searchsorted(ring[order], pos)
            found = order[np.where(at == len(ring), 0, at)]
        return ring[found] - pos, self.place[found]


def _blocks(spark: SparkSession, sources: DataFrame, block_bytes: int) -> Iterator[Broadcast]:
    """Broadcast blocks of ``sources`` (place, tail, units), of about ``block_bytes`` each."""
    count = max(1, -(-sources.count() * BLOCK_ROW_BYTES // block_bytes))
    for n in range(count):
        rows = sources.where(F.pmod(F.xxhash64("place"), F.lit(count)) == n).toPandas()
        if len(rows):
            held = spark.sparkContext.broadcast(
                Block(rows["tail"].to_numpy(np.uint32), _powers(rows["units"].to_numpy()), rows["place"].to_numpy(np.int64))
            )
            yield held
            held.unpersist()


def _batches(wanted: DataFrame, n: int, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(tail, power) of the ``n`` targets of a constraint, each batch eight times the last, up to ``most``."""
    turn = F.pmod(F.xxhash64("rel"), F.lit(1 << 30))
    low, size = 0, FIRST_TARGETS
    while low < 1 << 30:
        high = min(1 << 30, low + -(-(1 << 30) * size // n))
        rows = wanted.where((turn >= low) & (turn < high)).select("tail", "units").distinct().toPandas()
        if len(rows):
            yield rows["tail"].to_numpy(np.uint32), _powers(rows["units"].to_numpy())
        low, size = high, min(most, size * 8)


def _kept(
    seeds: np.ndarray, pairs: Callable, own: Block, other: Block, first_only: bool = False
) -> Iterator[pd.DataFrame]:
    """The pairs (seed, target) whose nearest source of ``own`` comes before all of ``other``."""
    held, size = [], 0
    for seed in seeds:
        state = np.uint32(literal_state(str(seed)))
        target, pos = pairs(seed, state)
        gap, place = own.nearest(state, pos)
        gap_, place_ = other.nearest(state, pos)
        target = target[(gap < gap_) | ((gap == gap_) & (place < place_))]
        if first_only:
            target = target[:1]
        held.append(pd.DataFrame({"seed": np.full(len(target), seed), "target": target}))
        size += len(target)
        if size > PAIRS_AT_ONCE:
            yield pd.concat(held)
            held, size = [], 0
    if size:
        yield pd.concat(held)


def _nearer(open_: DataFrame, batch: Broadcast, own: Broadcast, other: Broadcast, last: bool) -> DataFrame:
    """Pairs (seed, target) of the first round: all targets of ``batch`` for each seed. In the last
    round one target is enough."""

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tail, power = batch.value
        all_ = np.arange(len(tail))

        def pairs(_, state):
            with np.errstate(over="ignore"):
                return all_, final_array(state * power + tail)

        for rows in batches:
            yield from _kept(rows["seed"].to_numpy(np.int64), pairs, own.value, other.value, last)

    return open_.mapInPandas(search, "seed bigint, target bigint")


def _still_nearer(pairs_: DataFrame, batch: Broadcast, own: Broadcast, other: Broadcast) -> DataFrame:
    """Pairs that are left after one more block; a seed's pairs may be in several tasks."""

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tail, power = batch.value
        for rows in batches:
            targets = {seed: group.to_numpy() for seed, group in rows.groupby("seed")["target"]}

            def pairs(seed, state, targets=targets):
                at = targets[seed]
                with np.errstate(over="ignore"):
                    return at, final_array(state * power[at] + tail[at])

            yield from _kept(np.array(list(targets), np.int64), pairs, own.value, other.value)

    return pairs_.mapInPandas(search, "seed bigint, target bigint")


def _met(
    spark: SparkSession, open_: DataFrame, batch: tuple, own: DataFrame, rest: DataFrame, block_bytes: int
) -> DataFrame:
    """(seed) of ``open_`` with a target of ``batch`` that lands on one of the sources ``own``.

    A pair is met if some block of ``own`` is nearer than every block of ``rest``; other blocks of
    ``own`` can't spoil it.
    """
    targets, met = spark.sparkContext.broadcast(batch), None
    others = max(1, -(-rest.count() * BLOCK_ROW_BYTES // block_bytes))
    for mine in _blocks(spark, own, block_bytes):
        left = None
        for n, other in enumerate(_blocks(spark, rest, block_bytes), 1):
            if left is None:
                left = cut_lineage(_nearer(open_, targets, mine, other, n == others))
            else:
                left = cut_lineage(_still_nearer(left, targets, mine, other))
        found = left.select("seed").distinct()
        met = found if met is None else met.unionByName(found)
    return cut_lineage(met.distinct())


def _search_in_blocks(
    spark: SparkSession,
    sources: DataFrame,
    wanted: DataFrame,
    constraints: list[tuple[str, str]],
    seeds: range,
    partitions: int,
    block_bytes: int,
) -> DataFrame:
    tail, suffix = "concat(':overlay:', rel)", "concat(':', rel)"
    held = _fitting(sources, "rel", [text for _, text in constraints], "cids")
    placed = held.repartitionByRange(partitions, "source").sortWithinPartitions("source")
    # Numbers that rise from one partition to the next follow the order of paths.
    placed = cut_lineage(
        placed.select(
            "cids", F.monotonically_increasing_id().alias("place"), hash_state(tail).alias("tail"), _units(tail).alias("units")
        )
    )
    probes = cut_lineage(wanted.select("cid", "rel", hash_state(suffix).alias("tail"), _units(suffix).alias("units")))
    counts = {r["cid"]: r["n"] for r in probes.groupBy("cid").agg(F.count("*").alias("n")).collect()}
    if len(counts) < len(constraints):
        return spark.range(0).withColumnRenamed("id", "seed")
    alive = spark.range(seeds.start, seeds.stop, seeds.step, partitions).withColumnRenamed("id", "seed")
    for cid in sorted(counts, key=lambda c: counts[c]):
        fits = F.array_contains("cids", cid)
        own, rest = placed.where(fits), placed.where(~fits)
        if own.isEmpty():
            return spark.range(0).withColumnRenamed("id", "seed")
        if rest.isEmpty():  # every source will do
            continue
        open_, passed = alive, None
        most = max(1, block_bytes // PROBE_ROW_BYTES)
        for batch in _batches(probes.where(F.col("cid") == cid), counts[cid], most):
            met = _met(spark, open_, batch, own, rest, block_bytes)
            passed = met if passed is None else passed.unionByName(met)
            open_ = cut_lineage(open_.join(sizing.broadcast_if_small(met), "seed", "left_anti"))
            if open_.isEmpty():
                break
        alive = cut_lineage(passed.repartition(partitions))
        if alive.isEmpty():
            break
    return alive


def search_seeds(
    spark: SparkSession,
    sources: DataFrame,
    targets: DataFrame,
    constraints: list[tuple[str, str]],
    seeds: range,
    partitions: int | None = None,
    max_task_bytes: int = MAX_TASK_BYTES,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """``(seed)`` of every accepted seed in ``seeds``.

    ``sources(source, rel)``, ``targets(rel)``; constraints are (target text, source text),
    case-insensitive. The length of ``seeds`` is the cap on seeds tried. Without sources no
    seed is accepted. Up to ``max_task_bytes`` of hash states go to every task; beyond it, blocks of
    ``block_bytes``.
    """
    nothing = spark.range(0).withColumnRenamed("id", "seed")
    if not len(seeds) or sources.isEmpty():
        return nothing
    if not constraints:
        return spark.range(seeds.start, seeds.stop, seeds.step).withColumnRenamed("id", "seed")
    sources = sources.select("source", normalise(F.col("rel")).alias("rel"))
    wanted = constrained_targets(targets, constraints)
    ring_size, probe_size = sizing.measure(sources), sizing.measure(wanted)
    partitions = partitions or spark.sparkContext.defaultParallelism * 4
    # What travels: a hash state and a length of each, and a flag of a source for each constraint.
    travels = ring_size.rows * (16 + len(constraints)) + probe_size.rows * 16
    if travels <= max_task_bytes:
        return _search_by_seed(spark, sources, wanted, constraints, seeds, partitions)
    return _search_in_blocks(spark, sources, wanted, constraints, seeds, partitions, block_bytes)
