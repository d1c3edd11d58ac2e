"""Hard negatives: exact integer scores of anchors against all rows, by Strassen's recursion.

Vectors become integers (``floor(256 * x)``), so every score is an exact inner product and ties are
real ties. Candidates are never shuffled: each task cuts its rows into tiles and multiplies them
with the anchors, which are broadcast in rounds of a bounded number of bytes. A round scans the
candidates twice: once within labels for the best positives, once across labels for the negatives
inside the window of each positive. A task keeps one small heap for each anchor (and positive),
merged tile by tile; what tasks have left is merged by a ranked window over those few rows.

Strassen's recursion halves all three sides, pads odd ones with a row or column of zeros, and does
seven products and eighteen additions a level. Integers wrap at 64 bits, which is exact as long as
the scores themselves fit; where they might not, the call ends in an error.

Rows without id, label or vector, or with a null or non-finite component, take no part. Vectors of
unequal length are padded with zeros; empty ones score 0. Of several anchors with one id the least
by (label, vector) is mined; a repeated candidate takes its places each time, but never as a partner of
the anchor with its id, and a positive repeated with one score is returned once. Equal scores are ordered by id. No anchors or no partners: no rows; other
columns are left out.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ringloom.llm.common import cut_lineage

LEAF = 64  # sides up to this are multiplied plainly
TILE_ROWS = 2048
ANCHORS_AT_ONCE = 512
ROUND_BYTES = 16 << 20  # of anchors, broadcast at once
SCALE = 256

_NONE = np.iinfo(np.int64).min


def strassen(a: np.ndarray, b: np.ndarray, leaf: int = LEAF) -> np.ndarray:
    """``a @ b`` of int64 matrices, modulo 2**64."""
    n, k, m = a.shape[0], a.shape[1], b.shape[1]
    if min(n, k, m) <= leaf:
        return a @ b
    if n % 2 or k % 2 or m % 2:
        wide = np.pad(a, ((0, n % 2), (0, k % 2)))
        return strassen(wide, np.pad(b, ((0, k % 2), (0, m % 2))), leaf)[:n, :m]
    i, j, l = n // 2, k // 2, m // 2
    a11, a12, a21, a22 = a[:i, :j], a[:i, j:], a[i:, :j], a[i:, j:]
    b11, b12, b21, b22 = b[:j, :l], b[:j, l:], b[j:, :l], b[j:, l:]
    p1 = strassen(a11 + a22, b11 + b22, leaf)
    p2 = strassen(a21 + a22, b11, leaf)
    p3 = strassen(a11, b12 - b22, leaf)
    p4 = strassen(a22, b21 - b11, leaf)
    p5 = strassen(a11 + a12, b22, leaf)
    p6 = strassen(a21 - a11, b11 + b12, leaf)
    p7 = strassen(a12 - a22, b21 + b22, leaf)
    out = np.empty((n, m), np.int64)
    out[:i, :l] = p1 + p4 - p5 + p7
    out[:i, l:] = p3 + p5
    out[i:, :l] = p2 + p4
    out[i:, l:] = p1 - p2 + p3 + p6
    return out


def whole_numbers(vectors: list, dims: int) -> np.ndarray:
    """Rows of ``floor(256 * x)``, padded with zeros to ``dims``."""
    out = np.zeros((len(vectors), dims), np.float64)
    lengths = np.fromiter(map(len, vectors), np.int64, len(vectors))
    if len(vectors):
        out[np.arange(dims) < lengths[:, None]] = np.concatenate(vectors).astype(np.float64)
    out = np.floor(out * SCALE)
    if np.abs(out).max(initial=0) >= 2.0**62:
        raise ValueError("components too large for 64-bit scores")
    return out.astype(np.int64)


def scores(anchors: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Inner products of all ``anchors`` with all ``rows``, as int64."""
    bound = int(np.abs(anchors).max(initial=0)) * int(np.abs(rows).max(initial=0)) * max(anchors.shape[1], 1)
    if bound >= 2**63:
        raise ValueError("scores may not fit 64 bits")
    return strassen(anchors, np.ascontiguousarray(rows.T))


class Heaps:
    """The ``k`` best (score, id) of each of ``n`` keys; the higher score, then the smaller id first."""

    def __init__(self, n: int, k: int):
        self.score = np.full((n, k), _NONE)
        self.id = np.full((n, k), np.iinfo(np.int64).max)
        self.held = np.zeros((n, k), bool)

    def merge(self, keys: np.ndarray, score: np.ndarray, ids: np.ndarray, held: np.ndarray) -> None:
        """Add a row of (score, id, whether it counts) to each key of ``keys``."""
        s = np.concatenate([self.score[keys], score], axis=1)
        i = np.concatenate([self.id[keys], ids], axis=1)
        h = np.concatenate([self.held[keys], held], axis=1)
        k = self.score.shape[1]
        # ~s turns order round without overflow.
        order = np.lexsort((i, ~s, ~h), axis=1)[:, :k]
        self.score[keys], self.id[keys], self.held[keys] = (np.take_along_axis(x, order, 1) for x in (s, i, h))

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        key, at = np.nonzero(self.held)
        return key, self.score[key, at], self.id[key, at]


def _first(score: np.ndarray, ids: np.ndarray, held: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The first ``k`` columns that are ``held``, of columns sorted by id, with the highest scores."""
    k = min(k, score.shape[1])
    order = np.lexsort((~score, ~held), axis=1)[:, :k]
    return np.take_along_axis(score, order, 1), ids[order], np.take_along_axis(held, order, 1)


def _tiles(batches: Iterator[pd.DataFrame], dims: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(ids, labels, vectors), sorted by id within a tile. Columns beyond ``dims`` meet zeros only."""
    for batch in batches:
        for start in range(0, len(batch), TILE_ROWS):
            tile = batch.iloc[start : start + TILE_ROWS]
            ids = tile["id"].to_numpy(np.int64)
            order = np.argsort(ids, kind="stable")
            vectors = [v[:dims] for v in tile["vector"].to_numpy()]
            yield ids[order], tile["label"].to_numpy(np.int64)[order], whole_numbers(vectors, dims)[order]


def _search_positives(shared, k: int) -> Callable:
    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, labels, vectors = shared.value[:3]
        heaps = Heaps(len(ids), k)
        for cand, label, rows in _tiles(batches, vectors.shape[1]):
            for one in np.unique(label):
                mine, same = np.flatnonzero(labels == one), label == one
                for start in range(0, len(mine), ANCHORS_AT_ONCE):
                    keys = mine[start : start + ANCHORS_AT_ONCE]
                    score = scores(vectors[keys], rows[same])
                    heaps.merge(keys, *_first(score, cand[same], cand[same][None, :] != ids[keys, None], k))
        key, score, found = heaps.rows()
        yield pd.DataFrame({"anchor_id": ids[key], "score": score, "id": found})

    return search


def _search_negatives(shared, k: int) -> Callable:
    """A window is a run of the candidates in order of score: its first ``k`` are the best."""

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, labels, vectors, of, positive, reached, low, high = shared.value
        heaps = Heaps(len(of), k)
        for cand, label, rows in _tiles(batches, vectors.shape[1]):
            for start in range(0, len(ids), ANCHORS_AT_ONCE):
                part = slice(start, start + ANCHORS_AT_ONCE)
                score = scores(vectors[part], rows)
                other = (label[None, :] != labels[part, None]) & (cand[None, :] != ids[part, None])
                order = np.lexsort((~score, ~other), axis=1)
                falling, others = ~np.take_along_axis(score, order, 1), other.sum(axis=1)
                keys = np.arange(*np.searchsorted(of, (start, min(start + ANCHORS_AT_ONCE, len(ids)))))
                if not len(keys):
                    continue
                row = of[keys] - start
                begin = np.array([np.searchsorted(falling[r, : others[r]], ~high[q]) for r, q in zip(row, keys, strict=True)])
                at = begin[:, None] + np.arange(k)
                inside = at < others[row][:, None]
                at = np.minimum(at, score.shape[1] - 1)
                value = ~falling[row[:, None], at]
                heaps.merge(keys, value, cand[order[row[:, None], at]], inside & (value >= low[keys][:, None]))
        key, score, found = heaps.rows()
        made = {"anchor_id": ids[of[key]], "positive_id": positive[key], "positive_score": reached[key], "score": score, "id": found}
        yield pd.DataFrame(made)

    return search


def usable(rows: DataFrame) -> DataFrame:
    """(id, label, vector) of rows that take part."""
    bad = F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    kept = rows.select(F.col("id").cast("long").alias("id"), F.col("label").cast("long").alias("label"), "vector")
    return kept.where(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("vector").isNotNull() & ~bad)


def _ranked(rows: DataFrame, keys: list[str], k: int) -> DataFrame:
    best = Window.partitionBy(*keys).orderBy(F.desc("score"), "id")
    return rows.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def _bounds(score: int, low: int, high: int) -> tuple[int, int]:
    """Least and greatest whole number n with low * score <= 100 * n <= high * score."""
    return -((-low * score) // 100), (high * score) // 100


def mine(
    rows: DataFrame,
    is_anchor: Column,
    positives: int = 5,
    negatives: int = 10,
    low: int = 30,
    high: int = 90,
    round_bytes: int = ROUND_BYTES,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    ``rows`` has (id, label, vector); ``is_anchor`` is a condition on id. For each of an anchor's
    best ``positives`` rows of its label, the best ``negatives`` rows of other labels whose score is
    ``low`` to ``high`` percent of the positive's.

    Anchors are taken in rounds by a hash of their id, as many as keep what is broadcast below
    ``round_bytes`` about; the scan of all rows repeats with each round, the rows do not move.
    """
    spark = rows.sparkSession
    rows = usable(rows)
    one = rows.where(is_anchor).groupBy("id").agg(F.min(F.struct("label", "vector")).alias("row"))
    anchors = cut_lineage(one.select("id", "row.label", "row.vector"))
    size = anchors.agg(F.count("*").alias("n"), F.coalesce(F.max(F.size("vector")), F.lit(0)).alias("dims")).first()
    per_anchor = size["dims"] * 8 + positives * (32 + negatives * 17)
    rounds = max(1, -(-size["n"] * per_anchor // round_bytes))
    found = []
    for n in range(rounds if size["n"] else 0):
        part = anchors.where(F.pmod(F.xxhash64("id"), F.lit(rounds)) == n).toPandas().sort_values("id")
        if not len(part):
            continue
        ids, labels = part["id"].to_numpy(np.int64), part["label"].to_numpy(np.int64)
        vectors = whole_numbers(list(part["vector"]), size["dims"])
        shared = spark.sparkContext.broadcast((ids, labels, vectors))
        near = rows.mapInPandas(_search_positives(shared, positives), "anchor_id long, score long, id long")
        near = cut_lineage(_ranked(near, ["anchor_id"], positives))
        pairs = near.toPandas().drop_duplicates(["anchor_id", "id", "score"]).sort_values(["anchor_id", "rank"])
        of = np.searchsorted(ids, pairs["anchor_id"].to_numpy(np.int64))
        reached = pairs["score"].to_numpy(np.int64)
        bounds = np.array([_bounds(int(s), low, high) for s in reached], np.int64).reshape(-1, 2)
        windows = (ids, labels, vectors, of, pairs["id"].to_numpy(np.int64), reached, bounds[:, 0], bounds[:, 1])
        shared = spark.sparkContext.broadcast(windows)
        schema = "anchor_id long, positive_id long, positive_score long, score long, id long"
        far = rows.mapInPandas(_search_negatives(shared, negatives), schema)
        found.append(_ranked(far, ["anchor_id", "positive_id", "positive_score"], negatives))
    columns = ["anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")]
    if not found:
        empty = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
        return spark.createDataFrame([], empty)
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out.select(*columns)
