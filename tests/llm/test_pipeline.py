"""The pipeline's stages, each on what the one before left, against plain versions."""

from __future__ import annotations

import __spark_entry__ as entry
import corpus_pipeline
from ringloom.llm.common import table
from scripts.compare import connect, differences
from tests.llm.test_decontaminate import brute as contamination
from tests.llm.test_mixing import brute as mixed
from tests.llm.test_simhash import brute_components, brute_print

import pytest

SMALL = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = table(spark, SMALL, "documents")
    columns, items = docs.columns, [(r["item_id"], r["text"]) for r in table(spark, SMALL, "benchmark").collect()]
    steps = {}
    for name, stage in corpus_pipeline.STAGES:
        before = [(r["doc_id"], r["text"], r["source"]) for r in docs.collect()]
        rows = stage(spark, docs, SMALL).collect()
        steps[name] = (before, rows)
        docs = spark.createDataFrame(rows, docs.schema) if name != "mixing sources" else docs
        if name != "mixing sources":
            assert list(rows[0].asDict()) == columns
    before, rows = steps["toxicity"]
    assert 0.5 * len(before) < len(rows) < len(before)
    before, rows = steps["line dedup"]
    assert [i for i, _, _ in sorted(before)] == sorted(r["doc_id"] for r in rows)
    lines = [x for r in rows for x in (r["text"] or "").split("\n") if len(x) >= 30]
    assert len(lines) == len(set(lines)) == len({x for _, t, _ in before for x in (t or "").split("\n") if len(x) >= 30} & set(lines))
    before, rows = steps["simhash near-dedup"]
    before.sort()
    roots = brute_components([brute_print(t) for _, t, _ in before])
    assert sorted(r["doc_id"] for r in rows) == [before[i][0] for i in sorted(set(roots))]
    before, rows = steps["benchmark decontamination"]
    assert sorted(r["doc_id"] for r in rows) == sorted(i for i, t, _ in before if not contamination(t, items)[4])
    before, rows = steps["mixing sources"]
    assert sorted((r["doc_id"], r["size"], r["source_size"], round(r["target"], 6), r["taken"]) for r in rows) == sorted(mixed(before))


def test_registered():
    names = entry.queries()
    assert "pipeline" in names and all(sum(n.startswith(f"op{k}_") for n in names) == 1 for k in range(1, 11))


@pytest.mark.parametrize("name", ["op1_mixing", "op4_decontaminate", "op5_warc"])
def test_query_equals_sql(spark, name):
    _, problems = differences(spark, connect(SMALL), SMALL, name)
    assert not problems
