"""Contamination against a scan in plain Python."""

from __future__ import annotations

import random
import re
from hashlib import sha256

import pytest

from ringloom.llm import decontaminate
from tests.llm.conftest import awkward, prose


def words(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)


def brute(text, items):
    w, hit, met = words(text), set(), set()
    lists = {n: {} for n in range(1, 14)}
    for item, item_text in items:
        v = words(item_text)
        for g in [v[i : i + 13] for i in range(max(1, len(v) - 12))] if v else []:
            lists[len(g)].setdefault(tuple(g), set()).add(str(item) if item is not None else "null")
    for n, grams in lists.items():
        for i in range(len(w) - n + 1) if grams else ():
            if owners := grams.get(tuple(w[i : i + n])):
                hit |= set(range(i, i + n))
                met |= owners
    said = sha256(",".join(sorted(met)).encode()).hexdigest()
    return len(w), len(hit), len(met), said, len(hit) > 0 and 20 * len(hit) >= len(w)


@pytest.fixture(scope="module")
def case():
    draw = random.Random(9)
    rows = awkward(draw)
    items = [(i, prose(draw, n)) for i, n in enumerate((30, 13, 12, 5, 1, 40))]
    items += [(6, None), (7, ""), (8, items[0][1].upper()), (None, items[1][1]), (10, "the the the"), (10, "of Éa")]
    for k, (_, t) in enumerate(items[:6]):
        rows.append((100 + k, prose(draw, 30) + " -- " + (t or "") + ", " + prose(draw, 200 * (k % 2)), "p"))
    rows.append((120, " ".join([items[1][1]] * 3) + " the the the the", "p"))
    return rows, items


@pytest.mark.parametrize("most", [64 << 20, -1])
def test_counts(spark, documents, case, most):
    rows, items = case
    bench = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, gram string")
    got = decontaminate.contamination(documents(rows), bench, max_broadcast_bytes=most).drop("key").collect()
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted((tuple(r) for r in got), key=key) == sorted(((i, *brute(t, items)) for i, t, _ in rows), key=key)


def test_shuffled_hashes_carry_no_texts(spark, documents, case, monkeypatch):
    """A very long document must not ship its words with each of its places."""
    rows, items = case
    seen = []
    monkeypatch.setattr(decontaminate, "cut_lineage", lambda df: seen.append(df) or df)
    windows = decontaminate.benchmark_windows(spark.createDataFrame(items, "item_id long, text string"))
    decontaminate._scan(documents(rows), windows, "doc_id", "text", -1)
    plan = seen[0]._sc._jvm.PythonSQLUtils.explainString(seen[0]._jdf.queryExecution(), "formatted")
    shuffled = [part for part in plan.split("\n\n") if re.match(r"\(\d+\) Exchange", part.strip())]
    assert shuffled and all("w#" not in part and "text#" not in part for part in shuffled if "start#" in part)
    assert any("start#" in part for part in shuffled)


def test_removal(spark, documents, case):
    rows, items = case
    bench = spark.createDataFrame(items, "item_id long, text string")
    docs = documents(rows)
    left = decontaminate.remove_contaminated(docs, bench)
    assert left.columns == docs.columns
    assert sorted(str(r["text"]) for r in left.collect()) == sorted(str(t) for _, t, _ in rows if not brute(t, items)[4])
    one = spark.createDataFrame([(1, "alpha beta gamma")], "item_id long, text string")
    cut = decontaminate.remove_spans(documents([(1, "(so Alpha, beta gamma; end", "s"), (2, None, "s"), (3, "alpha beta", "s")]), one)
    assert {r["doc_id"]: r["text"] for r in cut.collect()} == {1: "(so end", 2: None, 3: "alpha beta"}


def test_empty_tables(spark, documents):
    none = spark.createDataFrame([], "item_id long, text string")
    got = decontaminate.contamination(documents([(1, "a b", "s")]), none).collect()
    assert [(r["n_words"], r["n_hit"], r["contaminated"]) for r in got] == [(2, 0, False)]
    assert decontaminate.contamination(documents([]), none).count() == 0
