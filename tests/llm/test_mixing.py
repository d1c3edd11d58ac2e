"""The mix against a plain recomputation."""

from __future__ import annotations

import random
import re
from collections import defaultdict
from hashlib import md5

import pytest

from ringloom.llm import mixing
from tests.llm.conftest import awkward


def brute_targets(sizes, total):
    names = sorted((n for n in sizes if n is not None), key=lambda n: n.encode()) + [n for n in sizes if n is None]
    weight = {n: (3, 1, 2)[i % 3] for i, n in enumerate(names)}
    target, left, open_ = {}, total, set(names)
    while True:
        level = left / sum(weight[n] for n in open_) if open_ else 0
        over = [n for n in open_ if level * weight[n] > 2 * sizes[n]]
        if not over:
            return target | {n: level * weight[n] for n in open_}
        for n in over:
            target[n] = float(2 * sizes[n])
            left -= target[n]
            open_.discard(n)


def brute_played(sizes, targets, block, golden):
    names = sorted((n for n in sizes if n is not None), key=lambda n: n.encode()) + [n for n in sizes if n is None]
    quota = {n: int(targets[n] + 0.5) for n in names}
    total = sum(quota.values())
    block = block or min(8192, max(1, total // 16384))
    edges = [sum(quota[m] for m in names[: i + 1]) / max(1, total) for i in range(len(names))]
    slots = defaultdict(int)
    for i in range(max(1, -(-total // block))):
        slots[names[sum(e <= i * golden % 1 for e in edges)]] += 1
    return {n: min(2 * sizes[n], max(quota[n] * 99 // 100, min(quota[n] * 101 // 100, slots[n] * block))) for n in names}


def brute(rows, block=None, golden=0.6180339887498949):
    size = [len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for _, t, _ in rows]
    sizes = defaultdict(int)
    for (_, _, s), n in zip(rows, size, strict=True):
        sizes[s] += n
    targets = brute_targets(dict(sizes), 1.5 * sum(size))
    played = brute_played(sizes, targets, block, golden)
    made = []
    for source in sizes:
        own = [(md5(f"42:{'' if i is None else i}".encode()).hexdigest(), -1 if i is None else i, n) for (i, _, s), n in zip(rows, size, strict=True) if s == source]
        quota, pos = played[source], 0
        for _, i, n in sorted(own):
            taken = sum(max(0, min(at + n, quota) - at) for at in (pos, pos + sizes[source]))
            made.append((None if i < 0 else i, n, sizes[source], round(targets[source], 6), taken))
            pos += n
    return made


@pytest.mark.parametrize(("block", "golden"), [(7, mixing.GOLDEN), (500, mixing.GOLDEN), (8192, mixing.GOLDEN), (7, 0.001)])
def test_taken_words(spark, documents, block, golden, monkeypatch):
    monkeypatch.setattr(mixing, "GOLDEN", golden)
    rows = awkward(random.Random(1))
    made = mixing.mix(documents(rows), block_words=block)
    got = [(r["doc_id"], r["size"], r["source_size"], round(r["target"], 6), r["taken"]) for r in mixing.taken(made).collect()]
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted(got, key=key) == sorted(brute(rows, block, golden), key=key)
    for r in made.sources.collect():
        assert r["quota"] * 0.99 - 1 <= r["played"] <= min(r["quota"] * 1.01, 2 * r["source_size"])


def test_schedule_decides(spark, documents, monkeypatch):
    rows = [(i, "w " * 50, f"s{i % 4}") for i in range(400)]
    made = mixing.mix(documents(rows), block_words=7)
    by_slots = [r for r in made.sources.collect() if r["played"] == r["slots"] * 7]
    assert len(by_slots) >= 2
    before = sorted((r["doc_id"], r["taken"]) for r in mixing.taken(made).collect())
    monkeypatch.setattr(mixing, "GOLDEN", 0.001)
    assert before != sorted((r["doc_id"], r["taken"]) for r in mixing.taken(mixing.mix(documents(rows), block_words=7)).collect())


def test_schedule_keeps_near_the_weights_everywhere(spark, documents):
    rows = [(i, "w " * 50, f"s{i % 4}") for i in range(200)]
    made = mixing.mix(documents(rows), block_words=20)
    slots = [(r["slot"], r["sid"]) for r in made.schedule.orderBy("slot").collect()]
    share = {r["sid"]: r["target"] for r in made.sources.collect()}
    total = sum(share.values())
    for n in range(50, len(slots), 50):
        for sid, target in share.items():
            assert abs(sum(s == sid for _, s in slots[:n]) - n * target / total) < 6
    words = {}
    for r in made.picks.collect():
        words[r["slot"]] = words.get(r["slot"], 0) + r["words"]
    blocks = {r["sid"]: r["block"] for r in made.sources.collect()}
    assert all(words.get(slot, 0) <= blocks[sid] for slot, sid in slots)


def test_no_words(spark, documents):
    assert mixing.taken(mixing.mix(documents([]))).count() == 0
    only = mixing.taken(mixing.mix(documents([(1, "", "a"), (2, None, None)]))).collect()
    assert [(r["size"], r["target"], r["taken"]) for r in only] == [(0, 0.0, 0)] * 2
