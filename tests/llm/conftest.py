from __future__ import annotations

import os
import random
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key long, score double, fp long, size long, line string"


@pytest.fixture(scope="session")
def documents(spark):
    """A frame of documents from (doc_id, text, source), with columns whose names clash."""

    def make(rows, lang="en"):
        full = [(i, t, lang, s, len(t) if t is not None else None, 1, 0.5, 7, 3, "x") for i, t, s in rows]
        return spark.createDataFrame(full, SCHEMA)

    return make


def prose(draw: random.Random, words: int, vocabulary: int = 400) -> str:
    made = []
    for _ in range(words):
        n = draw.randrange(vocabulary)
        made.append("".join("bdfglmnprst"[(n * 7 + k * 3) % 11] + "aeiou"[(n // 5 + k) % 5] for k in range(1 + n % 4)))
    return " ".join(made)


def awkward(draw: random.Random) -> list:
    """Rows with nulls, empty, blank and very long texts, ties, repeats and accents."""
    base = prose(draw, 60)
    rows = [(i, prose(draw, draw.randrange(1, 90)), f"s{i % 3}") for i in range(30)]
    rows += [(40, None, "s0"), (41, "", "s1"), (42, "  \n\t ", None), (None, base, "s1"), (43, base, None), (44, base, "s2")]
    rows += [(45, base + " extra", "s2"), (46, "Éa İx ſecret Straße " + base, "z"), (47, "a", "s0"), (47, "a", "s0")]
    rows += [(48, prose(draw, 20_000), "s0"), (49, base.upper(), "s1"), (50, "one two", "s1"), (51, "Two\nlines\n\n" + base, "s1")]
    return rows
