"""Collocations against counts and integers of any size in plain Python."""

from __future__ import annotations

import random
import re
import tracemalloc
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from ringloom.llm import collocations as co

from .conftest import awkward

ASCII = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def pieces(text):
    return [[w for w in re.split("[ \t]+", p) if w] for p in re.split("[.,;:!?\n\x0b\x0c\r]", (text or "").translate(ASCII))]


def brute(docs, longest=5, least=3, share=100, top=2000):
    f: dict = {}
    for _, text, lang in docs:
        for words in pieces(text):
            for k in range(1, longest + 1):
                for i in range(len(words) - k + 1):
                    f.setdefault(lang or "und", Counter())[tuple(words[i : i + k])] += 1
    out = []
    for lang, counts in f.items():
        n = sum(c for p, c in counts.items() if len(p) == 1)
        often = {p: c for p, c in counts.items() if len(p) > 1 and c >= least}
        inner = Counter()
        for p, c in often.items():
            for k in range(2, len(p)):
                for i in range(len(p) - k + 1):
                    inner[p[i : i + k]] = max(inner[p[i : i + k]], c)
        rows = []
        for p, a in often.items():
            if 100 * inner[p] >= share * a:
                continue
            score, k = min((1000 * a * n // (counts[p[:k]] * counts[p[k:]]), k) for k in range(1, len(p)))
            rows.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        for rank, (score, a, phrase, l, r) in enumerate(sorted(rows)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, l, r, n, -score))
    return sorted(out)


def table():
    draw = random.Random(3)
    vocabulary = [f"w{i}" for i in range(60)] + ["Ünï", "日本", "a b", "x y", "don't", "<s>"]
    docs = [(i, t, None) for i, t, _ in awkward(random.Random(1))]
    for i in range(300):
        words = [draw.choice(vocabulary[: draw.choice([5, 20, len(vocabulary)])]) for _ in range(draw.randrange(40))]
        text = "".join(w + draw.choice([" "] * 12 + ["\t", ", ", ".", "\n", " \r", " ! ", "\x0b", "\x0c"]) for w in words)
        docs.append((i, text.upper() if i % 9 == 0 else text, ["en", "de", None][i % 3]))
    docs += [(500 + i, "one Fixed phrase of five words, one fixed phrase of five words again", "en") for i in range(40)]
    docs += [(600, "...,,,", "zz"), (601, "aa " * 5000, "rr"), (602, "", "qq"), (603, None, "qq")]
    return docs


SCHEMA = "doc_id long, text string, lang string, n long, f long, phrase string, shard string"


@pytest.fixture(scope="module")
def frame(spark):
    return spark.createDataFrame([(*d, 1, 2, "x", "y") for d in table()], SCHEMA).repartition(6)


@pytest.mark.parametrize("least, share, top, rounds, bits", [(3, 100, 2000, 1 << 18, None), (2, 60, 25, 3000, 14), (5, 100, 3, 300, 16)])
def test_mined_equals_brute_force(frame, least, share, top, rounds, bits):
    got = co.mine(frame, least=least, share=share, top=top, round_phrases=rounds, bits=bits)
    assert sorted(tuple(r) for r in got.collect()) == brute(table(), least=least, share=share, top=top)


def test_tiny_shards_give_the_same_rows(frame, monkeypatch):
    monkeypatch.setattr(co, "SHARD_BYTES", 200)
    monkeypatch.setattr(co, "_code_type", lambda n: np.uint32 if n % 2 else np.uint16)
    assert sorted(tuple(r) for r in co.mine(frame, least=4).collect()) == brute(table(), least=4)


def test_clashing_numbers_are_made_anew(frame, monkeypatch):
    tried, clashes = [], co._clashes
    monkeypatch.setattr(co, "_clashes", lambda words: not tried.append(words) and len(tried) < 3 or clashes(words))
    assert sorted(tuple(r) for r in co.mine(frame, least=20, longest=2).collect()) == brute(table(), least=20, longest=2)
    assert len(tried) == 3


def test_clashes_are_seen(spark):
    for rows, want in (([(1, "a"), (2, "b")], False), ([(1, "a"), (1, "b")], True), ([(0, "a")], True)):
        assert co._clashes(spark.createDataFrame(rows, "id long, word string")) is want


def test_no_text(spark):
    assert co.mine(spark.createDataFrame([], SCHEMA)).count() == 0
    assert co.mine(spark.createDataFrame([(1, None, None, 1, 1, "", "")], SCHEMA)).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 400), st.integers(1, 5), st.integers(1, 2000), st.integers(0, 2**32))
def test_trie_counts_every_phrase(n, k, vocabulary, seed):
    draw = np.random.default_rng(seed)
    numbers = np.unique(draw.integers(1, 2**60, vocabulary))
    phrases = np.unique(draw.choice(numbers, (n, k)), axis=0)
    trie = co.build_trie(phrases)
    words = np.append(phrases[draw.integers(0, len(phrases), 60)].ravel(), draw.choice(numbers, 300))
    words = np.append(np.append(words, [0, 5]), words[:40])
    want = Counter(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    got = trie.count(words, np.arange(len(words)))
    assert [tuple(p) for p in trie.phrases] == sorted(map(tuple, phrases))
    assert got.tolist() == [want[tuple(p)] for p in trie.phrases]


def test_trie_of_wide_states_stays_small():
    a, b = np.meshgrid(np.arange(1, 301), np.arange(1, 801))
    phrases = np.stack([a.ravel(), b.ravel()], axis=1)
    trie = co.build_trie(phrases)
    assert (trie.count(phrases.ravel(), np.arange(phrases.size)) > 0).all()
    assert len(trie.check) < 40 * len(phrases)


@pytest.mark.parametrize("k", [2, 5])
def test_trie_of_a_full_round_is_small_to_build_and_to_send(k):
    """Common words go on to many others, rare ones to few: what the driver holds is bounded all the same."""
    draw = np.random.default_rng(k)
    words = draw.permutation(np.unique(draw.integers(1, 2**60, 60_000)))
    phrases = np.unique(words[(len(words) * draw.random((150_000, k)) ** 3).astype(int)], axis=0)
    tracemalloc.start()
    trie = co.build_trie(phrases)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(trie.check) < 3 * 2 * phrases.size  # two symbols a word
    assert peak < 150 * phrases.size  # bytes, 8 of them the word's number
    assert {a.dtype for a in (trie.base, trie.check, trie.accepts)} == {np.dtype(np.int32)}
    assert (trie.count(trie.phrases.ravel(), np.arange(phrases.size)) > 0).all()


def test_scores_pass_64_bits(spark):
    big = [(10**15, 9 * 10**17, 10**16, 10**15), (7, 3, 2, 5)]
    df = spark.createDataFrame(big, "a long, n long, l long, r long")
    assert [r[0] for r in df.select(co._score("a", "n", "l", "r")).collect()] == [1000 * a * n // (l * r) for a, n, l, r in big]


def test_rare_words_are_looked_up_once_a_shard_not_at_each_place(monkeypatch):
    numbers = np.zeros(1 << 16, np.int64)
    numbers[:50] = np.arange(1, 51)
    codes = np.tile(np.arange(50, dtype=np.uint16), 4000)
    hashed = []
    buckets = co._buckets
    monkeypatch.setattr(co, "_buckets", lambda words, at, k, bits: hashed.append(len(at)) or buckets(words, at, k, bits))
    none, all_ = np.zeros(1 << 14, np.uint64), np.full(1 << 14, ~np.uint64(0))
    for k in (2, 3):
        assert len(co._safe(numbers, codes, numbers[codes], k, 20, none, all_)) == 0
        assert sum(hashed) <= len(numbers)
        hashed.clear()
    assert len(co._safe(numbers, codes, numbers[codes], 2, 20, all_, all_)) == len(codes) - 1
