"""Hard negatives against exact sums over all pairs in plain Python integers."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ringloom.llm import hard_negatives as hn

SCHEMA = "id long, label int, vector array<float>, score long, anchor_id long"


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 40), st.integers(0, 40), st.integers(1, 40), st.integers(0, 2**32), st.sampled_from([1, 2, 5, 64]))
def test_strassen_is_exact(n, k, m, seed, leaf):
    draw = np.random.default_rng(seed)
    a, b = draw.integers(-(2**28), 2**28, (n, k)), draw.integers(-(2**28), 2**28, (k, m))
    want = [[sum(int(x) * int(y) for x, y in zip(r, c)) for c in b.T] for r in a]
    assert hn.strassen(a, b, leaf).tolist() == want


def test_strassen_recurses():
    a = np.arange(300 * 200, dtype=np.int64).reshape(300, 200) - 7
    b = np.arange(200 * 170, dtype=np.int64).reshape(200, 170) % 1009 - 500
    assert (hn.strassen(a, b, 16) == a @ b).all()


def whole(vector):
    return [math.floor(x * 256) for x in np.array(vector, np.float32).astype(float)]


def brute(rows, every=10, positives=5, negatives=10, low=30, high=90):
    kept = [r for r in rows if None not in r[:3] and all(x is not None and math.isfinite(x) for x in r[2])]
    vectors = [whole(r[2]) for r in kept]
    anchors: dict = {}
    for r, v in zip(kept, vectors):
        if r[0] % every == 0:
            anchors[r[0]] = min(anchors.get(r[0], (r[1], list(r[2]), v)), (r[1], list(r[2]), v))
    out = set()
    for anchor, (label, _, va) in anchors.items():
        scored = sorted(((-sum(x * y for x, y in zip(va, v)), r[0], r[1]) for r, v in zip(kept, vectors) if r[0] != anchor))
        near = [(-s, i) for s, i, l in scored if l == label][:positives]
        for score, positive in near:
            far = [(-s, i) for s, i, l in scored if l != label and low * score <= -100 * s <= high * score]
            out |= {(anchor, positive, n, i, score, s) for n, (s, i) in enumerate(far[:negatives], 1)}
    return out


def table(seed: int):
    draw = random.Random(seed)
    rows = []
    for i in range(260):
        label = 0 if draw.random() < 0.4 else draw.randrange(4)
        base = [0.3 * ((label * 5 + k) % 4) - 0.3 for k in range(7)]
        rows.append((i, label, [b + draw.choice([0, 0.1, -0.2, draw.gauss(0, 0.2)]) for b in base]))
    rows += [(300 + i, 1, rows[20][2]) for i in range(60)] + [(400 + i, 2, rows[20][2]) for i in range(60)]
    rows += [(None, 1, [1.0] * 7), (500, None, [1.0] * 7), (510, 1, None), (520, 1, [1.0, None]), (530, 1, [float("nan")] * 7), (540, 1, [float("inf")] * 7)]
    rows += [(550, 1, []), (560, 1, [0.5] * 3), (570, 2, [0.5] * 12), (571, 3, [0.5] * 12), (580, 9, [0.1] * 7), (30, 2, [0.9] * 7), (55, 0, rows[55][2])]
    return [(*r, 5, 6) for r in rows]


@pytest.mark.parametrize("round_bytes", [1, 20_000, hn.ROUND_BYTES])
@pytest.mark.parametrize("tile", [7, hn.TILE_ROWS])
def test_mined_equals_brute_force(spark, monkeypatch, round_bytes, tile):
    if round_bytes == 1:
        round_bytes = 4_000
    rows = table(round_bytes)
    monkeypatch.setattr(hn, "TILE_ROWS", tile)
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = [tuple(r) for r in hn.mine(df, F.col("id") % 10 == 0, round_bytes=round_bytes).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(rows)


def test_no_rows_and_no_anchors(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert hn.mine(empty, F.col("id") % 10 == 0).count() == 0
    lone = spark.createDataFrame([(1, 1, [1.0], 0, 0), (10, 1, [1.0], 0, 0)], SCHEMA)
    assert hn.mine(lone, F.col("id") % 100 == 0).count() == 0
    assert hn.mine(lone, F.col("id") % 10 == 0).count() == 0  # a positive but no other label


def test_scores_beyond_64_bits_are_an_error(spark):
    rows = [(0, 1, [1e12], 0, 0), (1, 1, [1e12], 0, 0)]
    with pytest.raises(Exception, match="64"):
        hn.mine(spark.createDataFrame(rows, SCHEMA), F.col("id") == 0).collect()
