"""Toxicity and language models: gradients, held-out accuracy, and odd texts."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ringloom.llm import language_id, toxicity
from ringloom.llm.common import held_out, is_held_out, table
from tests.llm.conftest import awkward, prose

SMALL = "/root/testdata/sf0.01"


def test_held_out_fold(spark):
    got = spark.range(2000).select("id", held_out(F.col("id")).alias("h")).collect()
    assert all(r["h"] == is_held_out(r["id"]) for r in got)
    assert 300 < sum(r["h"] for r in got) < 500


def test_gradients():
    draw = np.random.default_rng(1)
    p = {k: v.astype(np.float64) for k, v in toxicity._start(3).items()}
    x, mask = draw.normal(size=(5, 4, toxicity.FEATURES)), np.ones((5, 4), bool)
    mask[3:, 1] = False
    y = np.array([0.0, 1.0, 1.0, 0.0])

    def loss():
        s = toxicity._sigmoid(toxicity._forward(x, mask, p))
        return -(y * np.log(s) + (1 - y) * np.log(1 - s)).sum()

    keep = {}
    error = toxicity._sigmoid(toxicity._forward(x, mask, p, keep)) - y
    grad = toxicity._backward(x, error, p, keep)
    for name, value in p.items():
        for at in list(np.ndindex(value.shape))[:: max(1, value.size // 5)]:
            old, step = value[at], 1e-5
            value[at] = old + step
            up = loss()
            value[at] = old - step
            down = loss()
            value[at] = old
            assert abs((up - down) / (2 * step) - np.asarray(grad[name])[at]) < 2e-3, name


def test_windows_are_those_of_the_network():
    draw = random.Random(2)
    odds = np.random.default_rng(2).normal(size=(2, toxicity.BUCKETS)).astype(np.float32)
    model = toxicity.Model(odds, toxicity._start(5), 0.5)
    texts = [prose(draw, n) for n in (0, 1, 15, 16, 17, 40, 400)] + [None, "!!! ..."]
    got = toxicity.score_texts(texts, model)
    for text, score in zip(texts, got, strict=True):
        words = toxicity._Vocabulary(odds)
        rows = words.rows(toxicity.tokens(text))
        worst = 0.0
        for a in range(max(1, len(rows) - toxicity.WIDTH + 1)):
            part = np.concatenate([rows[a : a + toxicity.WIDTH], np.zeros(toxicity.WIDTH, np.int64)])[: toxicity.WIDTH]
            logit = toxicity._forward(words.table[part][:, None, :], (part > 0)[:, None], model.weights)
            worst = max(worst, float(toxicity._sigmoid(logit)[0]))
        assert score == pytest.approx(worst, abs=1e-4)


def test_long_texts_are_scored_in_overlapping_pieces(monkeypatch):
    draw = random.Random(2)
    odds = np.random.default_rng(2).normal(size=(2, toxicity.BUCKETS)).astype(np.float32)
    model, text = toxicity.Model(odds, toxicity._start(5), 0.5), prose(draw, 3000)
    whole = toxicity.score_texts([text], model)[0]
    monkeypatch.setattr(toxicity, "BATCH_WORDS", 64)
    monkeypatch.setattr(toxicity, "CACHE", 50)
    assert toxicity.score_texts([text, "a", text], model)[2] == pytest.approx(whole, abs=1e-4)


@pytest.mark.parametrize("before", [0, 30, 60, 63, 64, 100, 5000])
def test_all_of_a_very_long_word_is_read(before):
    text = "漢" * before + "grobnix" + "字" * 70
    grams = {(n, text[i : i + n]) for n in toxicity.GRAMS for i in range(len(text) - n + 1)}
    assert grams <= {(n, t[i : i + n]) for t in toxicity.tokens(text) for n in toxicity.GRAMS for i in range(len(t) - n + 1)}
    assert any("grobnix" in t for t in toxicity.tokens(text)) and toxicity.tokens("a" * 64 + " b") == ["a" * 64, "b"]
    odds = np.zeros((2, toxicity.BUCKETS), np.float32)
    odds[1, np.concatenate([g for g, _ in toxicity._gram_buckets(["grobnix"])])] = 1
    words = toxicity._Vocabulary(odds)
    rows = words.rows(toxicity.tokens(text))
    assert words.table[rows, 2].max() == 1
    whole = toxicity._features(["x" * 80 + "grobnix"], odds)
    assert whole[0, 2] == 1


def test_toxic_documents_are_found(spark, documents):
    draw = random.Random(8)
    bad = ("grobnix", "trolvex", "snarfik")
    rows, labels = [], []
    for i in range(900):
        words, toxic = prose(draw, draw.randrange(20, 200)).split(), i % 5 == 0
        for _ in range(3 if toxic else 0):
            words.insert(draw.randrange(len(words)), draw.choice(bad) + draw.choice(("", "a", "ol", "ung")))
        rows.append((i, " ".join(words), "s"))
        labels.append((i, int(toxic), 1))
    docs, known = documents(rows + awkward(draw)), spark.createDataFrame(labels, "doc_id long, toxic int, score int")
    model = toxicity.fit(docs.where("doc_id is null or doc_id < 900"), known.where(~held_out(F.col("doc_id"))))
    scored = toxicity.with_score(docs, model, name="tox").collect()
    assert len(scored) == len(rows) + len(awkward(random.Random(8)))
    assert all(0 <= r["tox"] <= 1 for r in scored)
    truth = dict((i, t) for i, t, _ in labels)
    test = [(truth[r["doc_id"]], r["tox"] >= 0.5) for r in scored if r["n_chars"] and r["doc_id"] is not None and r["doc_id"] >= 100 and is_held_out(r["doc_id"])]
    assert np.mean([p for t, p in test if t]) > 0.9
    assert np.mean([p for t, p in test if not t]) < 0.1
    left = toxicity.drop_toxic(docs, model)
    assert left.columns == docs.columns
    assert left.count() == sum(r["tox"] < 0.5 for r in scored)


def test_one_class_or_none(spark, documents):
    docs = documents([(1, "a b", "s"), (2, None, "s")])
    for labels, want in (([], 0.0), ([(1, 0)], 0.0), ([(1, 1), (2, None)], 1.0)):
        model = toxicity.fit(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
        assert {r["s"] for r in toxicity.with_score(docs, model, name="s").collect()} == {want}
    assert toxicity.with_score(documents([]), model, name="s").count() == 0


def test_languages_held_out(spark):
    docs = table(spark, SMALL, "documents")
    model = language_id.fit(docs.where(~held_out(F.col("doc_id"))))
    found = language_id.with_language(docs, model).where(held_out(F.col("doc_id"))).collect()
    assert len(found) > 100
    assert np.mean([r["lang"] == r["lang_pred"] for r in found]) > 0.97
    assert all(0 <= r["score"] <= 1 for r in found)


def test_language_of_odd_texts(spark, documents):
    draw = random.Random(1)
    docs = documents(awkward(draw) + [(90, "12 %% 34", "s")])
    model = language_id.fit(documents([(i, prose(draw, 50), "s") for i in range(20)], lang="en").union(documents([(i, "żółw " * 30, "s") for i in range(20, 40)], lang="pl")))
    got = language_id.with_language(docs, model).collect()
    for r in got:
        has = r["text"] is not None and any(c.isalpha() for c in r["text"])
        assert r["lang_pred"] in (("en", "pl") if has else ("und",))
    assert language_id.identify("żółw", model)[0] == "pl"
    text = prose(draw, 300) + " żółw" * 20
    whole = language_id.identify(text, model)
    nothing = language_id.fit(documents([(1, "abc", "s")], lang=None))
    assert language_id.identify(text, nothing) == ("und", 0.0)
    assert whole[0] == "en"


def test_bloom_planes_are_a_filter():
    """No n-gram of a language is ever missed, and chance is what is expected of others."""
    draw = np.random.default_rng(0)
    inside, outside = (draw.integers(0, 1 << 63, 100_000).astype(np.uint64) for _ in range(2))
    plane = np.zeros(language_id.SLOTS, np.uint8)
    for slot in language_id._slots(inside):
        plane[slot] |= 1
    hit = lambda h: np.logical_and(*[plane[s] for s in language_id._slots(h)]).mean()
    assert hit(inside) == 1.0
    assert hit(outside) == pytest.approx(plane.mean() ** language_id.HASHES, abs=0.002)
