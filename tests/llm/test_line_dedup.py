"""Line dedup against all pairs of lines."""

from __future__ import annotations

import random
from hashlib import md5

import pytest

from ringloom.llm import line_dedup
from tests.llm.conftest import awkward, prose


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def change(draw, text, edits):
    for _ in range(edits):
        at = draw.randrange(max(1, len(text)))
        text = draw.choice((text[:at] + "é" + text[at:], text[:at] + text[at + 1 :], text[:at] + "x" + text[at + 1 :]))
    return text


@pytest.mark.parametrize("most", [1, 2, 3])
def test_edit_distance_and_shared_segments(most):
    draw = random.Random(most)
    for _ in range(3000):
        a = "".join(draw.choice("ab") for _ in range(draw.randrange(1, 14)))
        b = change(draw, a + "b", draw.randrange(0, 4)) or "a"
        near = distance(a, b) <= most
        assert line_dedup.within_edits(a, b, most) == near
        if near and a != b and min(len(a), len(b)) > most:
            under = [{(m, i, t[at : at + n]): own for m, i, at, n, own in sorted(line_dedup.places(len(t), most), key=lambda x: x[4])} for t in (a, b)]
            assert any(under[0][k] or under[1][k] for k in under[0].keys() & under[1].keys())


@pytest.fixture(scope="module")
def rows():
    draw = random.Random(4)
    known = [prose(draw, draw.randrange(9, 30)) for _ in range(40)]
    made = [(i, "\n".join(draw.choice(known) if draw.random() < 0.4 else change(draw, draw.choice(known), draw.randrange(1, 4)) for _ in range(draw.randrange(1, 8))), "s") for i in range(60)]
    hot = known[0]
    made += [(100 + i, hot + "\n" + change(draw, hot, 1) + "\nshort", "s") for i in range(30)]
    return made + [(i and i + 300, t, s) for i, t, s in awkward(draw) if i != 48 and i != 0]


def brute(rows, most, least):
    lines = []
    for i, text, _ in rows:
        lines += [(i, n, line) for n, line in enumerate((text or "").split("\n"))]
    texts = sorted({x for *_, x in lines if len(x) >= least})
    ids = {t: md5(t.encode()).hexdigest() for t in texts}
    near = {t: [u for u in texts if u != t and abs(len(u) - len(t)) <= most and distance(t, u) <= most] for t in texts}
    root = {}
    for t in sorted(texts, key=ids.get):
        todo = [] if t in root else [t]
        while todo:
            u = todo.pop()
            if u not in root:
                root[u] = ids[t]
                todo += near[u]
    first = {}
    for i, n, x in lines:
        if x in root:
            first[root[x]] = min(first.get(root[x], (2,)), (i is None, i or 0, n))
    return {(i, n, root.get(x), len(near.get(x, ())), x not in root or first[root[x]] == (i is None, i or 0, n)) for i, n, x in lines}


@pytest.mark.parametrize("chunk", [256, 8])
def test_lines_of_all_documents(spark, documents, rows, chunk, monkeypatch):
    monkeypatch.setattr(line_dedup.links, "__defaults__", (2, chunk))
    got = {(r["doc_id"], r["line_no"], r["class_id"], r["links"], r["kept"]) for r in line_dedup.dedupe_lines(documents(rows)).collect()}
    assert got == brute(rows, 2, 30)


def test_cut_lines(spark, documents, rows):
    docs = documents(rows)
    kept = {}
    for i, n, _, _, keep in brute(rows, 2, 30):
        kept.setdefault(i, {})[n] = keep
    got = line_dedup.drop_repeated_lines(docs)
    assert got.columns == docs.columns
    out = got.collect()
    assert len(out) == len(rows)
    for r in out:
        text = next(t for i, t, _ in rows if i == r["doc_id"])
        left = [x for n, x in enumerate((text or "").split("\n")) if kept[r["doc_id"]][n]]
        assert (r["text"] or "") == "\n".join(left)
        assert r["n_chars"] == (len(r["text"]) if r["text"] is not None else None)


def test_no_lines(spark, documents):
    assert line_dedup.dedupe_lines(documents([])).count() == 0
    assert line_dedup.drop_repeated_lines(documents([(1, None, "s")])).first()["text"] is None


def test_lines_of_any_length(spark, documents):
    """Every line that is not empty has a class; short ones may differ by a tenth of the longer one."""
    draw = random.Random(9)
    words = ["}", "ab", "All rights reserved.", "x" * 9, "short line", "a line of 19 chars.", "twenty nine characters in it."]
    texts = {w for word in words for w in (word, *(change(draw, word, n) for n in (0, 1, 1, 1, 2, 2) for _ in range(3)))}
    texts = sorted(texts | {"", "x" * 8, "twenty nine characters in it.!!", "a line of 19 chars.z"})
    made = [(i, "\n".join(draw.choice(texts) for _ in range(12)), "s") for i in range(60)]
    seen = sorted({x for _, t, _ in made for x in t.split("\n") if x})
    allowed = lambda t, u: min(2, max(len(t), len(u)) // 10)
    near = {t: [u for u in seen if t != u and abs(len(t) - len(u)) <= allowed(t, u) and distance(t, u) <= allowed(t, u)] for t in seen}
    root = {t: t for t in seen}
    ids = {t: md5(t.encode()).hexdigest() for t in seen}
    for _ in seen:
        root = {t: min((root[u] for u in [t, *near[t]]), key=ids.get) for t in seen}
    first = {}
    for i, t, _ in made:
        for n, x in enumerate(t.split("\n")):
            first.setdefault(root.get(x), (i, n))
    got = line_dedup.dedupe_lines(documents(made), min_chars=1).collect()
    assert len(got) == 60 * 12
    for r in got:
        x = made[r["doc_id"]][1].split("\n")[r["line_no"]]
        want = (ids[root[x]], len(near[x]), first[root[x]] == (r["doc_id"], r["line_no"])) if x else (None, 0, True)
        assert (r["class_id"], r["links"], r["kept"]) == want, x


def test_stage_cuts_short_copies(spark, documents):
    import corpus_pipeline

    docs = documents([(1, "All rights reserved.\nalpha", "s"), (2, "beta\nAll rights reserved.\n", "s")])
    got = {r["doc_id"]: r["text"] for r in corpus_pipeline.drop_repeated_lines(spark, docs, "").collect()}
    assert got == {1: "All rights reserved.\nalpha", 2: "beta\n"}
