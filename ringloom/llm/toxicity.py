"""Toxicity: a bidirectional gated recurrent network with attention pooling, in numpy.

A word enters as two parts: what labelled documents say of the word (a hashed bucket) and of
its character n-grams (mean and maximum over hashed buckets). Both are smoothed log-odds of
being in a toxic document, beside random signs of the buckets and shape features. The network
reads a window of words from every place in both directions, pools its states by attention
and gives a probability; a document scores as its worst window.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ringloom.llm.common import cut_lineage

WIDTH = 16  # words in a window
LONGEST = 64  # characters of a word; a longer one is read as pieces that overlap by half
HIDDEN = 8
BUCKETS = 1 << 16
GRAMS = (3, 4, 5)
SIGNS = 3  # random signs of a bucket that tell words apart
PER_CLASS = 2_000  # labelled documents of each class that are learned from, about: the bound
WINDOWS_KEPT = 4  # training windows of a document, of those at every half window; scoring reads all
EPOCHS = 6
LEAST_STEPS = 600  # of training, when windows are few
SEED = 7
FALSE_ALARM_COST = 4  # a clean document that goes, in toxic ones that stay
CACHE = 300_000
BATCH_WORDS = 1 << 13  # what one step of the network works on stays in the cache

_WORD = re.compile(r"[^\W_]+")
FEATURES = 5 + 2 * SIGNS


class Model(NamedTuple):
    """What scoring needs; ``weights`` None: no two classes to learn from, only a prior."""

    odds: np.ndarray  # float32 [2, BUCKETS]: of words, of character n-grams
    weights: dict | None
    prior: float


def tokens(text: str | None) -> list[str]:
    """Words; of one of more than ``LONGEST`` characters, as in text without spaces, all its pieces."""
    found = _WORD.findall((text or "").lower())
    if any(len(w) > LONGEST for w in found):
        half = LONGEST // 2
        found = [w[at : at + LONGEST] for w in found for at in range(0, len(w) - half if len(w) > LONGEST else 1, half)]
    return found


def _word_buckets(words: list[str]) -> np.ndarray:
    return np.array([crc32(w.encode("utf-8", "surrogatepass")) for w in words], np.int64) % BUCKETS


def _gram_buckets(words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each length of n-gram: their buckets, and the word each is of, in order.

    N-grams are hashed over one array of code points for all words, with marks at both ends.
    """
    marked = [f"<{w}>" for w in words]
    code = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    word = np.repeat(np.arange(len(marked)), np.fromiter(map(len, marked), np.int64, len(marked)))
    for n in GRAMS:
        last = len(code) - n + 1
        if last > 0:
            h = np.full(last, n, np.uint64)
            for k in range(n):
                h = h * np.uint64(0x100000001B3) + code[k : last + k]
            inside = word[:last] == word[n - 1 :]
            yield (h[inside] * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)).astype(np.int64) % BUCKETS, word[:last][inside]


def _signs(bucket: np.ndarray) -> list[np.ndarray]:
    return [np.where(bucket * (2 * k + 3) * 2654435761 >> 16 & 1, 0.3, -0.3) for k in range(SIGNS)]


def _features(words: list[str], odds: np.ndarray) -> np.ndarray:
    """[word, FEATURES]; every word has an n-gram, as a letter between marks is one."""
    n = len(words)
    total, count, top, first = np.zeros(n), np.zeros(n), np.full(n, -np.inf), np.zeros(n, np.int64)
    for grams, word in _gram_buckets(words):
        chars, starts = odds[1, grams], np.flatnonzero(np.diff(word, prepend=-1))
        total += np.bincount(word, chars, n)
        count += np.bincount(word, minlength=n)
        top[word[starts]] = np.maximum(top[word[starts]], np.maximum.reduceat(chars, starts))
        first[word[starts]] = grams[starts]
    own = _word_buckets(words)
    length = np.fromiter(map(len, words), np.float32, n)
    columns = [odds[0, own], total / count, top, np.minimum(length, 20) / 10, np.ones(n), *_signs(own), *_signs(first)]
    return np.stack(columns, axis=1).astype(np.float32)


class _Vocabulary(dict):
    """Word -> row of ``table``, which holds its features; row 0 is no word."""

    def __init__(self, odds: np.ndarray):
        super().__init__()
        self.odds, self.new, self._table = odds, [], np.zeros((1, FEATURES), np.float32)

    def __missing__(self, word: str) -> int:
        self[word] = row = len(self) + 1
        self.new.append(word)
        return row

    def rows(self, words: list[str]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.int64, len(words))

    @property
    def table(self) -> np.ndarray:
        n = len(self) + 1
        if self.new:
            if n > len(self._table):
                grown = np.zeros((2 * n, FEATURES), np.float32)
                grown[: len(self._table)] = self._table
                self._table = grown
            self._table[n - len(self.new) : n] = _features(self.new, self.odds)
            self.new = []
        return self._table[:n]

    def forget(self) -> None:
        self.clear()
        self.new, self._table = [], np.zeros((1, FEATURES), np.float32)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def _squash(x: np.ndarray) -> np.ndarray:
    """The softsign x / (1 + |x|), which costs a tenth of tanh; a gate is (1 + softsign) / 2."""
    return x / (1 + np.abs(x))


def _start(seed: int) -> dict:
    draw = np.random.default_rng(seed)
    norm = lambda *s: draw.normal(0, 1 / np.sqrt(s[0]), s).astype(np.float32)
    made = {}
    for side in "fb":
        made |= {f"W{side}": norm(FEATURES, 3 * HIDDEN), f"U{side}": norm(HIDDEN, 3 * HIDDEN), f"c{side}": np.zeros(3 * HIDDEN, np.float32)}
    return made | {"a": norm(2 * HIDDEN), "o": norm(2 * HIDDEN), "b": np.zeros(1, np.float32)}


def _run(inputs: list[np.ndarray], u: np.ndarray, keep: list | None = None) -> list[np.ndarray]:
    """Hidden states of a gated recurrent unit over the projected inputs of consecutive words."""
    h, states = np.zeros((len(inputs[0]), HIDDEN), np.float32), []
    u_gates, u_new = np.ascontiguousarray(u[:, : 2 * HIDDEN]), np.ascontiguousarray(u[:, 2 * HIDDEN :])
    for x in inputs:
        gates = 0.5 * _squash(x[:, : 2 * HIDDEN] + h @ u_gates) + 0.5
        z, r = gates[:, :HIDDEN], gates[:, HIDDEN:]
        new = _squash(x[:, 2 * HIDDEN :] + (r * h) @ u_new)
        if keep is not None:
            keep.append((h, z, r, new))
        h = h + z * (new - h)
        states.append(h)
    return states


def _pool(states: np.ndarray, mask: np.ndarray, p: dict) -> tuple[np.ndarray, ...]:
    """states [T, B, 2H], mask [T, B] -> logits, attention, pooled."""
    raw = np.where(mask, states @ p["a"], np.float32(-30))
    weight = np.exp(raw - raw.max(axis=0))
    weight /= weight.sum(axis=0)
    pooled = np.einsum("tb,tbh->bh", weight, states)
    return pooled @ p["o"] + p["b"][0], weight, pooled


def _forward(x: np.ndarray, mask: np.ndarray, p: dict, keep: dict | None = None) -> np.ndarray:
    """Logits of windows; x [T, B, FEATURES]."""
    steps = range(len(x))
    kept = {"f": [], "b": []} if keep is not None else {"f": None, "b": None}
    fore = _run([x[t] @ p["Wf"] + p["cf"] for t in steps], p["Uf"], kept["f"])
    back = _run([x[t] @ p["Wb"] + p["cb"] for t in reversed(steps)], p["Ub"], kept["b"])[::-1]
    states = np.concatenate([np.stack(fore), np.stack(back)], axis=2)
    logits, weight, pooled = _pool(states, mask, p)
    if keep is not None:
        keep |= {"kept": kept, "states": states, "weight": weight, "pooled": pooled}
    return logits


def _backward(x: np.ndarray, d_logit: np.ndarray, p: dict, keep: dict) -> dict:
    grad = {k: np.zeros_like(v) for k, v in p.items()}
    states, weight, pooled = keep["states"], keep["weight"], keep["pooled"]
    grad["o"], grad["b"] = pooled.T @ d_logit, np.array([d_logit.sum()], np.float32)
    d_pooled = d_logit[:, None] * p["o"]
    d_weight = np.einsum("tbh,bh->tb", states, d_pooled)
    d_raw = weight * (d_weight - (weight * d_weight).sum(axis=0))
    grad["a"] = np.einsum("tb,tbh->h", d_raw, states)
    d_states = weight[:, :, None] * d_pooled[None] + d_raw[:, :, None] * p["a"]
    for side, part in (("f", slice(0, HIDDEN)), ("b", slice(HIDDEN, None))):
        order = list(range(len(x))) if side == "f" else list(reversed(range(len(x))))
        w, u = p["W" + side], p["U" + side]
        d_h = np.zeros((x.shape[1], HIDDEN), np.float32)
        for n in reversed(range(len(order))):
            t = order[n]
            h, z, r, new = keep["kept"][side][n]
            d_h = d_h + d_states[t][:, part]
            d_new = d_h * z * (1 - np.abs(new)) ** 2
            d_rh = d_new @ u[:, 2 * HIDDEN :].T
            slopes = [0.5 * (1 - np.abs(2 * g - 1)) ** 2 for g in (z, r)]
            d_gates = np.concatenate([d_h * (new - h) * slopes[0], d_rh * h * slopes[1]], axis=1)
            grad["U" + side][:, : 2 * HIDDEN] += h.T @ d_gates
            grad["U" + side][:, 2 * HIDDEN :] += (r * h).T @ d_new
            d_x = np.concatenate([d_gates, d_new], axis=1)
            grad["W" + side] += x[t].T @ d_x
            grad["c" + side] += d_x.sum(axis=0)
            d_h = d_h * (1 - z) + d_rh * r + d_gates @ u[:, : 2 * HIDDEN].T
    return grad


def train_network(x: np.ndarray, mask: np.ndarray, y: np.ndarray, epochs: int = EPOCHS, seed: int = SEED) -> dict:
    """Adam on the cross entropy; x [B, T, FEATURES], classes weigh the same."""
    p, draw = _start(seed), np.random.default_rng(seed)
    first, second = ({k: np.zeros_like(v) for k, v in p.items()} for _ in range(2))
    importance = np.where(y > 0, 0.5 / max(y.mean(), 1e-6), 0.5 / max(1 - y.mean(), 1e-6)).astype(np.float32)
    step, in_epoch = 0, -(-len(y) // 128)
    epochs = max(epochs, -(-LEAST_STEPS // in_epoch))
    for _ in range(epochs):
        order = draw.permutation(len(y))
        for lo in range(0, len(y), 128):
            rows = order[lo : lo + 128]
            xs, ms, keep = np.ascontiguousarray(x[rows].transpose(1, 0, 2)), mask[rows].T, {}
            error = (_sigmoid(_forward(xs, ms, p, keep)) - y[rows]) * importance[rows] / len(rows)
            grad, step = _backward(xs, error.astype(np.float32), p, keep), step + 1
            rate = 0.01 * 0.05 ** (step / (epochs * in_epoch))
            for k, g in grad.items():
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                p[k] = p[k] - rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-6)
    return p


def _read(x: np.ndarray, u: np.ndarray, heads: np.ndarray, out: np.ndarray, backward: bool) -> None:
    """Adds to ``out`` [T, 2, windows] what both heads [2, HIDDEN] see in the states of one direction.

    x [3 * HIDDEN, words] are projected inputs. Gates stay twice as large; the halves are taken
    where they cost least. All is in place, in rows as long as the windows are many.
    """
    n = out.shape[2]
    u_gates, u_new = np.ascontiguousarray(u[:, : 2 * HIDDEN].T), 0.5 * u[:, 2 * HIDDEN :].T
    h, gates, new = (np.zeros((rows, n), np.float32) for rows in (HIDDEN, 2 * HIDDEN, HIDDEN))
    size = np.empty((2 * HIDDEN, n), np.float32)
    for t in reversed(range(WIDTH)) if backward else range(WIDTH):
        np.matmul(u_gates, h, out=gates)
        gates += x[: 2 * HIDDEN, t : t + n]
        np.abs(gates, out=size)
        size += 1
        gates /= size
        gates += 1
        z, r = gates[:HIDDEN], gates[HIDDEN:]
        r *= h
        np.matmul(u_new, r, out=new)
        new += x[2 * HIDDEN :, t : t + n]
        np.abs(new, out=size[:HIDDEN])
        size[:HIDDEN] += 1
        new /= size[:HIDDEN]
        new -= h
        z *= 0.5
        new *= z
        h += new
        out[t] += heads @ h


def window_logits(found: list[np.ndarray], table: np.ndarray, p: dict) -> list[np.ndarray]:
    """Logits of the windows from every place of each document, given rows of ``table`` (0: none)."""
    used = np.array([max(len(x), WIDTH) for x in found], np.int64)
    starts, total = np.concatenate(([0], np.cumsum(used)[:-1])), int(used.sum())
    row = np.zeros(total, np.int64)
    for at, x in zip(starts, found, strict=True):
        row[at : at + len(x)] = x
    features = np.ascontiguousarray(table[row].T)
    seen = np.zeros((WIDTH, 2, total - WIDTH + 1), np.float32)
    for s, part in (("f", slice(0, HIDDEN)), ("b", slice(HIDDEN, None))):
        heads = np.stack([p["a"][part], p["o"][part]])
        _read(p["W" + s].T @ features + p["c" + s][:, None], p["U" + s], heads, seen, s == "b")
    real = np.lib.stride_tricks.sliding_window_view(row > 0, WIDTH).T
    raw = np.where(real, seen[:, 0], np.float32(-30))
    weight = np.exp(raw - raw.max(axis=0))
    logits = (weight * seen[:, 1]).sum(axis=0) / weight.sum(axis=0) + p["b"][0]
    return [logits[a : a + n - WIDTH + 1] for a, n in zip(starts, used, strict=True)]


def worst_logits(texts: list[str | None], model: Model, words: _Vocabulary) -> np.ndarray:
    """The logit of the worst window of each whole text."""
    best = np.full(len(texts), -np.inf)
    held, whose, size = [], [], 0

    def flush() -> None:
        nonlocal held, whose, size
        if held:
            for i, logits in zip(whose, window_logits(held, words.table, model.weights), strict=True):
                best[i] = max(best[i], float(logits.max()))
        held, whose, size = [], [], 0

    for i, text in enumerate(texts):
        if len(words) > CACHE:
            flush()
            words.forget()
        found = words.rows(tokens(text))
        # A very long text goes in pieces that overlap by a window less a word: no window is lost.
        for at in range(0, max(1, len(found) - WIDTH + 1), BATCH_WORDS):
            held.append(found[at : at + BATCH_WORDS + WIDTH - 1])
            whose.append(i)
            size += len(held[-1]) + WIDTH
            if size >= BATCH_WORDS:
                flush()
    flush()
    return best


def score_texts(texts: list[str | None], model: Model, words: _Vocabulary | None = None) -> list[float]:
    """The probability of the worst window of each whole text, to six places: what is beyond depends on batches."""
    if model.weights is None:
        return [model.prior] * len(texts)
    found = worst_logits(texts, model, _Vocabulary(model.odds) if words is None else words)
    return [float(x) for x in np.round(_sigmoid(found), 6)]


def _labelled(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, per_class: int) -> DataFrame:
    """(text, y, half) of about ``per_class`` documents of each class, drawn by a hash of the id."""
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
    known = known.groupBy(F.col(id_col).alias("_id")).agg((F.max(label_col) > 0).cast("int").alias("y"))
    sizes = {r["y"]: r["count"] for r in known.groupBy("y").count().collect()}
    rate = F.element_at(F.array([F.lit(min(1.0, per_class / sizes.get(y, 1))) for y in (0, 1)]), F.col("y") + 1)
    draw = F.pmod(F.xxhash64(F.lit("toxicity"), "_id"), F.lit(1 << 30)) / float(1 << 30)
    known = known.where(draw < rate).select("_id", "y", F.pmod(F.xxhash64(F.lit("half"), "_id"), F.lit(2)).cast("int").alias("half"))
    # Broadcast: two classes of about ``per_class`` ids.
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).join(F.broadcast(known), F.col("doc_id") == F.col("_id")).select("text", "y", "half")


def fit(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    per_class: int = PER_CLASS,
) -> Model:
    """A model from labelled documents, about ``per_class`` of each class.

    They are drawn by a hash of the id, at the rate that gives that many. The network is trained
    on at most ``WINDOWS_KEPT`` windows of a document, those with its most suspicious words, so
    that clean documents contribute their hardest ones; their features come from log-odds of the
    other half of the documents, as if they had not been seen. Where scores part is set by the
    worst of all windows of each document. The log-odds of the model are those of both halves. Null labels and ids are left out; an id labelled twice
    is toxic if one label says so. With one class only, or no labels, the model is the share of
    toxic ones.
    """
    sample = cut_lineage(_labelled(docs, labels, id_col, text_col, label_col, per_class))
    counts = {(r["half"], r["y"]): r["count"] for r in sample.groupBy("half", "y").count().collect()}
    if len({y for _, y in counts}) < 2:
        return Model(np.zeros((2, BUCKETS), np.float32), None, float(any(y for _, y in counts)))

    def presence(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            total = np.zeros((2, 2, 2, BUCKETS), np.int32)
            for text, y, half in zip(frame["text"], frame["y"], frame["half"], strict=True):
                words = sorted(set(tokens(text)))
                if words:
                    total[half, y, 0, np.unique(_word_buckets(words))] += 1
                    total[half, y, 1, np.unique(np.concatenate([g for g, _ in _gram_buckets(words)]))] += 1
            half, y, kind, bucket = total.nonzero()
            yield pd.DataFrame({"half": half, "y": y, "kind": kind, "bucket": bucket, "n": total[half, y, kind, bucket]})

    keys = ["half", "y", "kind", "bucket"]
    seen = sample.mapInPandas(presence, ", ".join(f"{k} long" for k in [*keys, "n"])).groupBy(keys).agg(F.sum("n").alias("n")).toArrow()
    n = np.zeros((2, 2, 2, BUCKETS))
    n[tuple(seen[k].to_numpy() for k in keys)] = seen["n"].to_numpy()

    def log_odds(*halves: int) -> np.ndarray:
        met = n[list(halves)].sum(axis=0)
        shares = [(met[y] + 0.5) / (sum(counts.get((h, y), 0) for h in halves) + 1) for y in (0, 1)]
        return (np.log(shares[1] / shares[0]) * met.sum(axis=0) / (met.sum(axis=0) + 8)).astype(np.float32)

    odds, other = log_odds(0, 1), [log_odds(1), log_odds(0)]

    def windows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        both = [_Vocabulary(other[0]), _Vocabulary(other[1])]
        for frame in frames:
            ys, xs = [], []
            for text, y, half in zip(frame["text"].fillna(""), frame["y"], frame["half"], strict=True):
                words = both[half]
                if len(words) > CACHE:
                    words.forget()
                found = words.rows(tokens(text))
                padded = np.concatenate([found, np.zeros(WIDTH, np.int64)])
                suspicion = (words.table[:, 0] * 0.5 + words.table[:, 1] + words.table[:, 2] * 0.5)[padded]
                starts = np.arange(0, max(1, len(found) - WIDTH // 2), WIDTH // 2)
                worst = np.array([suspicion[a : a + WIDTH].max() for a in starts])
                keep = np.argsort(-worst, kind="stable")[: WINDOWS_KEPT // 2 if y else WINDOWS_KEPT].tolist()
                keep += [] if y else [len(starts) // 2]
                for k in keep:
                    rows = padded[starts[k] : starts[k] + WIDTH]
                    ys.append(y)
                    xs.append(np.concatenate([words.table[rows], (rows > 0)[:, None]], axis=1).astype(np.float32).tobytes())
            yield pd.DataFrame({"y": ys, "x": xs})

    made = sample.mapInPandas(windows, "y long, x binary").toArrow()
    raw = made["x"].to_pylist()
    both = np.frombuffer(b"".join(raw), np.float32).reshape(len(raw), WIDTH, FEATURES + 1)
    y = made["y"].to_numpy().astype(np.float32)
    order = np.lexsort((np.array([crc32(x) for x in raw]), y))  # whatever order tasks ended in
    x, mask, y = both[order, :, :FEATURES], both[order, :, FEATURES] > 0, y[order]
    network = train_network(x, mask, y)

    def worst(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        models, words = [Model(o, network, 0.0) for o in other], [_Vocabulary(o) for o in other]
        for frame in frames:
            for half, part in frame.groupby("half"):
                yield pd.DataFrame({"s": worst_logits(part["text"].tolist(), models[half], words[half]), "y": part["y"]})

    documents = sample.mapInPandas(worst, "s double, y long").toArrow()
    network["b"] = network["b"] - np.float32(_cut(documents["s"].to_numpy(), documents["y"].to_numpy()))
    return Model(odds, network, float(y.mean()))


def _cut(worst: np.ndarray, y: np.ndarray) -> float:
    """Where documents part by their worst windows: the middle of the span with the least loss."""
    order = np.lexsort((y, worst))
    s, toxic = worst[order], y[order] > 0
    missed = np.append(0, np.cumsum(toxic)) / max(1, toxic.sum())
    wronged = 1 - np.append(0, np.cumsum(~toxic)) / max(1, (~toxic).sum())
    loss = missed + FALSE_ALARM_COST * wronged
    best = np.flatnonzero(loss <= loss.min() + 1e-12)
    edges = np.concatenate(([s[0] - 1], s, [s[-1] + 1]))
    return float((edges[best[0]] + edges[best[-1] + 1]) / 2)


def with_score(docs: DataFrame, model: Model, text_col: str = "text", name: str = "score") -> DataFrame:
    """``docs`` with the toxicity of each whole text, 0 to 1, in a new column ``name``.

    Null, empty and wordless texts are one window without words. Equal texts score equal but
    for rounding; repeated rows and clashing columns (but ``name``) pass as they are.
    """

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        words = _Vocabulary(model.odds)
        for batch in batches:
            yield pd.Series(score_texts(batch.tolist(), model, words), dtype="float64")

    return docs.withColumn(name, score(F.coalesce(F.col(text_col), F.lit(""))))


def drop_toxic(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """``docs`` whose worst window is below ``threshold``."""
    return with_score(docs, model, text_col, "_toxicity").where(F.col("_toxicity") < threshold).drop("_toxicity")
