"""SimHash fingerprints and components against plain Python."""

from __future__ import annotations

import random
from collections import Counter

import xxhash

from ringloom.llm import simhash
from ringloom.llm.graph import components
from tests.llm.conftest import awkward


def brute_print(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s, seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints, most=3):
    root = list(range(len(prints)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= most:
                root[max(find(i), find(j))] = min(find(i), find(j))
    return [find(i) for i in range(len(prints))]


def test_fingerprints_and_components(spark, documents):
    rows = awkward(random.Random(3))
    found = simhash.near_duplicates(documents(rows)).collect()
    prints = [brute_print(t) for _, t, _ in rows]
    roots = brute_components(prints)
    least = {}
    for (i, _, _), r in zip(rows, roots, strict=True):
        if i is not None:
            least[r] = min(least.get(r, i), i)
    want = Counter((i, p, least.get(r)) for (i, _, _), p, r in zip(rows, prints, roots, strict=True))
    assert Counter((r["doc_id"], r["fp"] % (1 << 64), r["component_id"]) for r in found) == want


def test_spark_hash_is_the_same(spark, documents):
    from pyspark.sql import functions as F

    row = documents([(1, "ab cd ef", "s")]).select(F.xxhash64("text")).first()
    assert row[0] % (1 << 64) == xxhash.xxh64_intdigest(b"ab cd ef", seed=42)


def test_links_in_dense_and_chained_groups(spark):
    draw = random.Random(5)
    prints = set()
    for _ in range(40):
        x = draw.getrandbits(64)
        for _ in range(draw.randrange(1, 25)):
            prints.add(x)
            for _ in range(draw.randrange(1, 5)):
                x ^= 1 << draw.randrange(64)
    hot = draw.getrandbits(64)
    prints |= {hot ^ draw.getrandbits(9) for _ in range(300)}
    prints = sorted(prints)
    signed = [(p - (1 << 64) if p >> 63 else p,) for p in prints]
    for chunk in (2048, 16):
        edges = simhash.links(spark.createDataFrame(signed, "fp long"), chunk=chunk)
        root = {r["node"]: r["root"] for r in components(edges).collect()}
        groups, want = {}, {}
        for p, (s,), r in zip(prints, signed, brute_components(prints), strict=True):
            groups.setdefault(root.get(s, s), set()).add(p)
            want.setdefault(r, set()).add(p)
        assert sorted(map(sorted, groups.values())) == sorted(map(sorted, want.values()))


def test_one_document_stays(spark, documents):
    rows = awkward(random.Random(3))
    docs = documents(rows)
    left = simhash.drop_near_duplicates(docs)
    assert left.columns == docs.columns
    comps = {(r["doc_id"], r["key"]): r["component_id"] for r in simhash.near_duplicates(docs).collect()}
    kept = {r["doc_id"] for r in left.collect()}
    assert kept == {c for c in comps.values()}


def test_no_documents(spark, documents):
    assert simhash.near_duplicates(documents([])).count() == 0
    assert simhash.drop_near_duplicates(documents([])).count() == 0
