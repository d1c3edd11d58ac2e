"""Hash, ring, affix, salting and seed search against brute force."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ringloom.functions.hashing import batched_position, batched_state, hash_final, hash_state, literal_state, parse_seed, ring_position, seed_from_text
from ringloom.operators import affix, sizing
from ringloom.operators.affix import longest_affix
from ringloom.operators.assign import assign_frames, assign_targets
from ringloom.operators.classify import classify_targets
from ringloom.operators.overrides import match_rules
from ringloom.operators.ring import build_ring, look_up, prepare_ring
from ringloom.plans import seed_search
from ringloom.plans.seed_search import search_seeds

KNOWN = [
    ("", 0, 0),
    ("hello", 99162322, 2958086601),
    ("42:overlay:a/b.png", 3248390473, 3554257236),
    ("é漢字", 1129246, 1746503020),
    ("😀x", 54959989, 651201041),
]


def final(h: int) -> int:
    h = (h ^ (h >> 16)) * 73244475 & 0xFFFFFFFF
    return h ^ (h >> 16)


def owner(key: str, ring: list[tuple[int, str]]) -> str:
    pos = final(literal_state(key))
    return next((s for p, s in ring if p >= pos), ring[0][1])


def ring_of(sources, seed):
    return sorted((final(literal_state(f"{seed}:overlay:{s}")), s) for s in sources)


def test_known_hashes(spark):
    rows = spark.createDataFrame([(s,) for s, _, _ in KNOWN], "s string").select(
        "s", hash_state("s").alias("a"), ring_position("s").alias("f")
    )
    assert [tuple(r) for r in rows.collect()] == KNOWN
    assert all(literal_state(s) == a and final(a) == f for s, a, f in KNOWN)


def test_batched_hash_equals_expression(spark):
    rng = random.Random(8)
    alphabet = "ab/é漢😀\u0000 "
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(0, 30))) for _ in range(500)] + [None, ""]
    df = spark.createDataFrame([(t,) for t in texts], "s string").repartition(3)
    pairs = df.select(
        (batched_state("s", 77) == hash_state("s", 77)).alias("state"),
        (batched_position("s", 77) == ring_position("s", 77)).alias("position"),
    )
    assert [tuple(r) for r in pairs.distinct().collect()] == [(True, True)]


def test_hash_is_resumable(spark):
    words = ["", "a", "seed:", "漢😀", "x/y.png", "\\n", "a'b"]
    df = spark.createDataFrame([(a, b) for a in words for b in words], "a string, b string")
    head = df.withColumn("h", hash_state("a"))
    out = head.select(
        (ring_position("b", "h") == ring_position("concat(a, b)")).alias("same"),
        (hash_state("b", "h") == hash_state("concat(a, b)")).alias("state"),
    )
    assert out.distinct().collect() == [(True, True)]
    one = head.limit(1).withColumn("f", hash_final("h")).select((F.col("f") == ring_position("a")).alias("ok"))
    assert one.first()["ok"]


@pytest.mark.parametrize("text", ["42", " 42 ", "-7", "+7", "spring", "4.5", "99999999999999999999", "", "0x10", "漢"])
def test_seed_text_agrees_with_column(spark, text):
    got = spark.createDataFrame([(text,)], "s string").select(parse_seed("s").alias("v")).first()["v"]
    assert got == seed_from_text(text)


@pytest.fixture(scope="module")
def sources(spark):
    names = [f"src/{i}/é{i * 7919}.png" for i in range(300)]
    return names, spark.createDataFrame([(n, n) for n in names], "source string, rel string")


@pytest.fixture(scope="module")
def targets(spark):
    rng = random.Random(5)
    # A third of all rows share one path, so one bucket is hot.
    names = [f"t/{rng.randrange(10**9)}" for _ in range(2000)] + ["t/hot"] * 1000
    return names, spark.createDataFrame([(n, i) for i, n in enumerate(names)], "rel string, i int")


@pytest.mark.parametrize("limit", [None, 0])
def test_lookup_matches_brute_force_on_both_layouts(spark, sources, targets, limit):
    names, df = sources
    ring = prepare_ring(df, 42, max_broadcast_bytes=limit)
    assert ring.broadcastable == (limit is None)
    got = {r["i"]: r["overlay"] for r in assign_targets(targets[1], ring, 42).collect()}
    brute = ring_of(names, 42)
    assert got == {i: owner(f"42:{t}", brute) for i, t in enumerate(targets[0])}


@pytest.mark.parametrize("limit", [None, 0])
@pytest.mark.parametrize("count", [0, 1, 2])
def test_tiny_rings_wrap(spark, targets, count, limit):
    df = spark.createDataFrame([(f"s{i}", f"s{i}") for i in range(count)], "source string, rel string")
    got = assign_targets(targets[1], prepare_ring(df, 1, max_broadcast_bytes=limit), 1)
    ring = ring_of([f"s{i}" for i in range(count)], 1)
    want = {i: owner(f"1:{t}", ring) if ring else None for i, t in enumerate(targets[0])}
    assert {r["i"]: r["overlay"] for r in got.collect()} == want


def test_equal_positions_take_the_smallest_source(spark):
    df = spark.createDataFrame([("b", "same"), ("a", "same")], "source string, rel string")
    assert [r["source"] for r in build_ring(df, 3).collect()] == ["a"]


def test_extreme_positions(spark, sources):
    ring = prepare_ring(sources[1], 42)
    edge = spark.createDataFrame([(0,), (4294967295,)], "pos bigint")
    brute = ring_of(sources[0], 42)
    got = {r["pos"]: r["overlay"] for r in look_up(edge, ring).collect()}
    assert got[0] == brute[0][1]
    assert got[4294967295] == (brute[-1][1] if brute[-1][0] == 4294967295 else brute[0][1])


def test_removing_a_source_moves_only_its_targets(spark, sources, targets):
    names, df = sources
    unique = targets[1].dropDuplicates(["rel"])
    before = {r["rel"]: r["overlay"] for r in assign_targets(unique, prepare_ring(df, 9), 9).collect()}
    gone = before[targets[0][0]]
    after = assign_targets(unique, prepare_ring(df.filter(F.col("source") != gone), 9), 9).collect()
    moved = {r["rel"] for r in after if r["overlay"] != before[r["rel"]]}
    assert moved == {t for t, s in before.items() if s == gone}


@pytest.mark.parametrize("per_frame", [True, False])
def test_frames(spark, sources, per_frame):
    names, df = sources
    strips = spark.createDataFrame([("a/b", 12), ("c", 1)], "rel string, frames int")
    got = {(r["rel"], r["frame"]): r["overlay"] for r in assign_frames(strips, prepare_ring(df, 4), 4, per_frame).collect()}
    ring = ring_of(names, 4)
    want = {(t, f): owner(f"4:{t}:{f}" if f and per_frame else f"4:{t}", ring) for t, n in (("a/b", 12), ("c", 1)) for f in range(n)}
    assert got == want


@pytest.mark.parametrize("side", ["prefix", "suffix"])
@pytest.mark.parametrize("small", [True, False])
@pytest.mark.parametrize("probes", [1, 8])
def test_longest_affix_matches_brute_force(spark, monkeypatch, side, small, probes):
    monkeypatch.setattr(affix, "MAX_PROBES", probes)
    rng = random.Random(3)

    def word(n):
        return "".join(rng.choice("ab/") for _ in range(n))

    patterns = sorted({word(rng.randrange(1, 9)) for _ in range(60)}) + [""]
    texts = [word(rng.randrange(0, 14)) for _ in range(400)]
    p = spark.createDataFrame([(x, f"v{x}") for x in patterns], "pat string, val string")
    t = spark.createDataFrame(list(enumerate(texts)), "i int, txt string")
    got = {r["i"]: (r["pat"], r["val"]) for r in longest_affix(t, "txt", p, "pat", side, "i", small).collect()}

    def best(text):
        hit = [x for x in patterns if x and (text.startswith(x) if side == "prefix" else text.endswith(x))]
        return (max(hit, key=len), "v" + max(hit, key=len)) if hit else (None, None)

    assert got == {i: best(x) for i, x in enumerate(texts)}


def test_patterns_that_fit_once_but_not_for_each_probe_are_not_broadcast(spark, monkeypatch):
    monkeypatch.setattr(sizing, "BROADCAST_MAX_ROWS", 100)
    monkeypatch.setattr(affix, "MAX_PROBES", 3)

    def plan(count):
        p = spark.createDataFrame([("x" * (1 + i % 3) + str(i), i) for i in range(count)], "pat string, val int")
        t = spark.createDataFrame([(1, f"axxx{count - 1}")], "i int, txt string")
        found = longest_affix(t, "txt", p, "pat", "suffix", "i")
        assert found.first()["val"] == count - 1
        return found._jdf.queryExecution().optimizedPlan().toString()

    assert "strategy=broadcast" in plan(25)
    assert "strategy=broadcast" not in plan(60)


def test_spark_broadcasts_no_patterns_of_its_own_accord(spark, sources):
    p = spark.range(3000).selectExpr("concat('x', id) AS pat", "id AS val")
    t = spark.range(3000).selectExpr("id AS i", "concat('a/x', id) AS txt")
    found = longest_affix(t, "txt", p, "pat", "suffix", "i", False, max_broadcast_bytes=0)
    assert found.where("val = i").count() == 3000
    rows = found.where("val >= 0")
    rows.collect()
    assert "Broadcast" not in rows._jdf.queryExecution().executedPlan().toString()
    _, df = sources
    placed = assign_targets(t.withColumnRenamed("txt", "rel"), prepare_ring(df, 4, max_broadcast_bytes=0), 4)
    assert "hint=(strategy=merge)" in placed._jdf.queryExecution().optimizedPlan().toString() or "SortMergeJoin" in placed._jdf.queryExecution().sparkPlan().toString()


def test_no_patterns(spark):
    t = spark.createDataFrame([(1, "x")], "i int, txt string")
    none = spark.createDataFrame([("", 1)], "pat string, val int")
    row = longest_affix(t, "txt", none, "pat", "prefix", "i").first()
    assert (row["i"], row["pat"], row["val"]) == (1, None, None)


def test_rule_precedence(spark):
    rules = spark.createDataFrame(
        [("assets/block", 8), ("assets\\block\\stone", 2), ("assets/block/stone.png", 1), ("", 99)], "key string, scale int"
    )
    paths = ["assets/block/stone.png", "assets/block/stone2.png", "assets\\blocks_x", "pack.png"]
    t = spark.createDataFrame([(p, p) for p in paths], "target string, rel string")
    got = {r["target"]: (r["rule_key"], r["scale"]) for r in match_rules(t, rules).collect()}
    assert got == {
        paths[0]: ("assets/block/stone.png", 1),
        paths[1]: ("assets\\block\\stone", 2),
        paths[2]: ("assets/block", 8),
        paths[3]: (None, None),
    }


def test_classification_is_unanchored_and_separator_blind(spark):
    owners = spark.createDataFrame([("mc/cat.png", "cat"), ("b/mc/cat.png", "big")], "texture string, entity_id string")
    t = spark.createDataFrame([("x/mc\\cat.png",), ("amc/cat.png",), ("a/b/mc/cat.png",), ("cat.png",)], "target string")
    got = {r["target"]: r["entity_id"] for r in classify_targets(t, owners).collect()}
    assert got == {"x/mc\\cat.png": "cat", "amc/cat.png": "cat", "a/b/mc/cat.png": "big", "cat.png": None}


def test_salted_join_keeps_every_row_and_spreads_the_hot_key(spark):
    many = spark.range(9000).select(
        "id", F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.concat(F.lit("k"), F.col("id") % 50)).alias("k")
    )
    one = many.select("k").distinct().withColumn("payload", F.concat(F.lit("p"), "k"))
    left, right = sizing.salt_hot_keys(many, one, "k", ["id"], rows_per_salt=200)
    joined = left.join(right, ["k", "salt"], "left")
    assert joined.count() == 9000
    assert joined.filter("payload is null or payload != concat('p', k)").count() == 0
    spread = left.filter("k = 'hot'").groupBy("salt").count().collect()
    assert len(spread) == 15 and max(r["count"] for r in spread) < 400
    assert right.filter("k != 'hot'").agg(F.max("salt")).first()[0] == 0


CONSTRAINTS = [[("A/1", "3")], [("", "s1"), ("b/", "s2")], [("zzz", "s")], [("a", "")]]


@pytest.mark.parametrize("constraints", CONSTRAINTS)
def test_seed_search_plans_agree_with_brute_force(spark, monkeypatch, constraints):
    names = [f"s{i}" for i in range(40)]
    paths = [f"a/{i}" for i in range(30)] + [f"b/{i}" for i in range(3)]
    df = spark.createDataFrame([(n, n) for n in names], "source string, rel string")
    t = spark.createDataFrame([(p,) for p in paths], "rel string")
    seeds = range(-5, 90)

    def accepted(seed):
        ring = ring_of(names, seed)
        return all(
            any(o.lower() in owner(f"{seed}:{p}", ring) for p in paths if x.lower() in p) for x, o in constraints
        )

    want = [s for s in seeds if accepted(s)]
    monkeypatch.setattr(seed_search, "SEEDS_PER_BATCH", 16)
    monkeypatch.setattr(seed_search, "CELLS_PER_STEP", 200)
    monkeypatch.setattr(seed_search, "FIRST_TARGETS", 2)
    fast = search_seeds(spark, df, t, constraints, seeds)
    one_block = search_seeds(spark, df, t, constraints, seeds, max_task_bytes=0)
    blocks = search_seeds(spark, df, t, constraints, seeds, max_task_bytes=0, block_bytes=16 * 11)
    for found in (fast, one_block, blocks):
        assert sorted(r["seed"] for r in found.collect()) == want


@pytest.mark.parametrize("targets", [3, 60])
def test_nearest_source_of_a_block(targets):
    """Both ways to search a block, with positions that coincide and ones past the last source."""
    rng = np.random.default_rng(targets)
    tail, place = rng.integers(0, 2**32, 200).astype(np.uint32), rng.permutation(200)
    tail[50:100] = tail[:50]
    block = seed_search.Block(tail, np.ones(200, np.uint32), place)
    ring = [final(int(t)) for t in tail]
    pos = np.append(rng.integers(0, 2**32, targets - 2), [ring[3], 2**32 - 1]).astype(np.uint32)
    gap, found = block.nearest(np.uint32(0), pos)
    want = [min(((r - int(p)) % 2**32, q) for r, q in zip(ring, place.tolist())) for p in pos]
    assert list(zip(gap.tolist(), found.tolist())) == want


def test_seed_steps_and_no_sources(spark):
    sources = spark.createDataFrame([(f"/s{i}", f"s{i}.png") for i in range(6)], "source string, rel string")
    targets = spark.createDataFrame([(f"t{i}.png",) for i in range(20)], "rel string")
    wanted = [("t3", "s2")]
    every = {r[0] for r in search_seeds(spark, sources, targets, wanted, range(0, 60)).collect()}
    for seeds in (range(0, 60, 7), range(3, 60, 5)):
        for limit in (64 << 20, 0):
            got = {r[0] for r in search_seeds(spark, sources, targets, wanted, seeds, max_task_bytes=limit).collect()}
            assert got == every & set(seeds)
        assert search_seeds(spark, sources, targets, [], seeds).count() == len(seeds)
    assert search_seeds(spark, sources.limit(0), targets, [], range(5)).count() == 0


def test_many_warm_keys_are_all_salted(spark):
    from ringloom.operators.sizing import salt_hot_keys

    many = spark.range(6000).selectExpr("cast(id % 60 AS string) AS k", "id")
    one = spark.range(60).selectExpr("cast(id AS string) AS k", "id AS v")
    left, right = salt_hot_keys(many, one, "k", ["id"], rows_per_salt=20)
    assert left.groupBy("k", "salt").count().agg({"count": "max"}).first()[0] < 60
    assert left.join(right, ["k", "salt"]).count() == 6000


def test_rows_without_a_key_do_not_meet(spark):
    from ringloom.operators.sizing import join_left

    df = spark.range(500).selectExpr("id", "if(id % 5 = 0, cast(id AS string), null) AS k")
    other = spark.range(600).selectExpr("cast(id AS string) AS k", "id * 2 AS v")
    for small in (True, False):
        got = join_left(df, other, "k", small)
        assert set(got.columns) == {"id", "k", "v"}
        assert {(r["id"], r["v"]) for r in got.collect()} == {(i, 2 * i if i % 5 == 0 else None) for i in range(500)}


def test_a_ring_is_measured_as_it_is_broadcast(spark):
    """Two rows about for each source, each with three numbers beside it."""
    df = spark.range(1000).selectExpr("concat('a source with a name, ', id) AS source", "CAST(id AS string) AS rel")
    size = prepare_ring(df, 3).sources
    assert not prepare_ring(df, 3, max_broadcast_bytes=size.bytes).broadcastable
    assert prepare_ring(df, 3, max_broadcast_bytes=2 * (size.bytes + 24 * size.rows)).broadcastable
    intervals = prepare_ring(df, 3).intervals
    assert prepare_ring(df, 3, max_broadcast_bytes=size.bytes).intervals.exceptAll(intervals).isEmpty()
