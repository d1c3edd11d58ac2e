"""Many texts at once, against one search for each."""

from __future__ import annotations

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from ringloom.operators import matching
from ringloom.operators.search import with_priority
from ringloom.plans import seed_search


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text("abc", min_size=1, max_size=5), min_size=1, max_size=12, unique=True), st.lists(st.text("abcd", max_size=20), max_size=8))
def test_automaton_finds_what_search_finds(patterns, strings):
    rows, found = matching.build([p.encode() for p in patterns]).find([s.encode() for s in strings])
    got = set(zip(rows.tolist(), found.tolist()))
    assert len(got) == len(rows)
    assert got == {(r, i) for r, s in enumerate(strings) for i, p in enumerate(patterns) if p in s}


@pytest.mark.parametrize("table_bytes", [1, 4000, matching.TABLE_BYTES])
def test_hits_equal_a_chain_of_contains(spark, table_bytes):
    draw = random.Random(4)
    word = lambda n: "".join(draw.choice("abé/日") for _ in range(n))
    patterns = [word(draw.randrange(5)) for _ in range(20 if table_bytes == 1 else 60)] + ["a", "a", ""]
    texts = [word(draw.randrange(60)) for _ in range(200)] + ["", None, word(3000)]
    df = spark.createDataFrame([(t, 1) for t in texts], "t string, hits int").repartition(3)
    got = {r["t"]: r["found"] for r in matching.with_hits(df, "t", patterns, "found", table_bytes).collect()}
    assert got == {t: [i for i, p in enumerate(patterns) if t is not None and p in t] for t in texts}


def test_many_filters_pick_the_same_rows(spark):
    """Priorities and constraints with more texts than are chained."""
    draw = random.Random(6)
    paths = [f"{draw.choice(['A', 'b'])}/{draw.randrange(400)}\\x{draw.randrange(9)}.png" for _ in range(300)]
    texts = [str(i) for i in draw.sample(range(500), 120)] + ["", " B/1 ", "\\x3"]
    df = spark.createDataFrame([(p,) for p in paths], "rel string")
    lowered = [p.lower() for p in paths]
    scores = [r["score"] for r in with_priority(df, "rel", tuple(texts[:120])).collect()]
    assert scores == [next((i for i, t in enumerate(texts[:120]) if t in p), 120) for p in lowered]
    constraints = [(t, "s") for t in texts]
    got = sorted(tuple(r) for r in seed_search.constrained_targets(df, constraints).collect())
    slashed = [p.replace("\\", "/") for p in paths]
    want = [(c, p) for p in slashed for c, t in enumerate(texts) if t.replace("\\", "/").strip().lower() in p.lower()]
    assert got == sorted(want)


def test_no_patterns(spark):
    df = spark.createDataFrame([("a",)], "t string")
    assert matching.with_hits(df, "t", []).collect()[0]["hits"] == []
    assert matching.with_hits(df, "t", ["", ""]).collect()[0]["hits"] == [0, 1]


def test_numbers_make_a_small_automaton_in_one_lot():
    numbers = [str(i).encode() for i in range(20_000)]
    assert len(list(matching._lots(numbers, 2 << 20))) == 1
    made = matching.build(numbers)
    assert len(made.rows) == 20_001  # every number is a state, and the start
    assert len(made.step) < 3_000
