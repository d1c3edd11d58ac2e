"""Language identification with bit-sliced Bloom filters of character n-grams.

One array of slots holds a bit for each language. An n-gram hashes to a few slots; the bits
that all of them have set are the languages that contain it, all found by one look. A text is
decided by how many of its n-grams each language contains, less what the filter's fill makes
come out by chance.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

GRAMS = (2, 3, 4, 5)
SLOTS = 1 << 21
HASHES = 2
PER_LANGUAGE = 1_500  # labelled documents of a language that are learned from, about: the bound
MIN_COUNT = 2  # in the sample
MIN_SHARE = 0.2  # of the highest rate among languages, for a language to count as containing an n-gram
PIECE = 1 << 20  # characters looked at together
UNDETERMINED = "und"

_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))


class Model(NamedTuple):
    languages: list[str]
    planes: np.ndarray  # uint8 [ceil(languages / 8), SLOTS]
    chance: np.ndarray  # by language, that an n-gram it does not contain seems contained
    usual: int  # the language of most documents


def _codes(text: str) -> np.ndarray:
    """Lower-case letters as code points, everything else as single spaces."""
    lowered = "".join(c if c.isalpha() else " " for c in text) if not text.isascii() else text
    lowered = lowered.lower()
    codes = np.frombuffer(lowered.encode("utf-32-le", "surrogatepass"), np.uint32)
    if text.isascii():
        codes = np.where((codes >= 97) & (codes <= 122), codes, 32).astype(np.uint32)
    space = codes == 32
    keep = ~space | ~np.append(space[1:], False)
    return np.concatenate(([32], codes[keep], [32])).astype(np.uint64)


def _hashes(codes: np.ndarray) -> np.ndarray:
    """A 64-bit hash of every n-gram that no space stands inside of."""
    space = np.append(0, np.cumsum(codes == 32))
    made = []
    for n in GRAMS:
        last = len(codes) - n + 1
        if last <= 0:
            continue
        h = np.full(last, n, np.uint64)
        for k in range(n):
            h = h * np.uint64(0x100000001B3) + codes[k : last + k]
        inside = space[n - 1 : n - 1 + last] - space[1 : last + 1]
        letters = n - (space[n : n + last] - space[:last])
        made.append(h[(inside == 0) & (letters > 0)])
    return np.concatenate(made) if made else np.zeros(0, np.uint64)


def ngrams(text: str) -> Iterator[np.ndarray]:
    """Hashes of all n-grams of the whole text, piece by piece."""
    for lo in range(0, len(text), PIECE):
        yield _hashes(_codes(text[max(0, lo - max(GRAMS)) : lo + PIECE]))


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


def _slots(h: np.ndarray) -> list[np.ndarray]:
    return [((h ^ (h >> np.uint64(29))) * m >> np.uint64(43)).astype(np.int64) for m in _MIX[:HASHES]]


def fit(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", id_col: str = "doc_id", per_language: int = PER_LANGUAGE) -> Model:
    """A model from labelled documents, about ``per_language`` of each language.

    They are drawn by a hash of the id, at the rate that gives that many. A language counts as
    containing an n-gram that its sample has ``MIN_COUNT`` times or more, at ``MIN_SHARE`` or more
    of the rate of the language where it is most frequent. Null languages, texts and ids are
    left out. No labelled documents: no languages.
    """
    known = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & F.col(id_col).isNotNull())
    sizes = {r[0]: r[1] for r in known.groupBy(lang_col).count().collect()}
    languages = sorted(sizes)
    if not languages:
        return Model([], np.zeros((1, SLOTS), np.uint8), np.zeros(0), 0)
    number = {name: i for i, name in enumerate(languages)}
    draw = F.pmod(F.xxhash64(F.lit("language"), F.col(id_col)), F.lit(1 << 30)) / float(1 << 30)
    rates = F.create_map(*[F.lit(x) for name, n in sizes.items() for x in (name, min(1.0, per_language / n))])
    sample = known.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), draw.alias("draw"))
    sample = sample.where(F.col("draw") < F.element_at(rates, F.col("lang"))).select("lang", "text")

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for lang, texts in frame.groupby("lang")["text"]:
                held, size = [], 0
                for h in (h for text in texts for h in ngrams(text)):
                    held.append(h)
                    size += len(h)
                    if size >= 1 << 22:
                        yield counted(number[lang], held)
                        held, size = [], 0
                if held:
                    yield counted(number[lang], held)

    def counted(lang: int, held: list[np.ndarray]) -> pd.DataFrame:
        gram, n = np.unique(np.concatenate(held), return_counts=True)
        return pd.DataFrame({"lang": lang, "gram": gram.view(np.int64), "n": n})

    counts = sample.mapInPandas(count, "lang int, gram long, n long").groupBy("gram", "lang").agg(F.sum("n").alias("n"))
    total = {r[0]: r[1] for r in sample.groupBy("lang").agg(F.sum(F.length("text"))).collect()}
    share = F.create_map(*[F.lit(x) for name, i in number.items() for x in (i, 1.0 / max(1, total.get(name, 1)))])
    by_gram = counts.groupBy("gram").agg(F.collect_list(F.struct("lang", "n", (F.col("n") * F.element_at(share, F.col("lang"))).alias("rate"))).alias("all"))
    top = F.array_max(F.transform("all", lambda x: x["rate"]))
    held = F.filter("all", lambda x: (x["n"] >= MIN_COUNT) & (x["rate"] >= MIN_SHARE * F.col("top")))
    members = by_gram.withColumn("top", top).select("gram", F.explode(held).alias("x")).select("gram", "x.lang")

    def place(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            h, lang = frame["gram"].to_numpy(np.int64).view(np.uint64), frame["lang"].to_numpy(np.int64)
            for slot in _slots(h):
                yield pd.DataFrame({"slot": slot, "plane": lang // 8, "bits": 1 << (lang % 8)})

    placed = members.mapInPandas(place, "slot long, plane int, bits int").groupBy("plane", "slot").agg(F.bit_or("bits").alias("bits"))
    filled = placed.toArrow()  # at most a row for each slot and eight languages
    planes = np.zeros((-(-len(languages) // 8), SLOTS), np.uint8)
    planes[filled["plane"].to_numpy(), filled["slot"].to_numpy()] = filled["bits"].to_numpy()
    fill = np.concatenate([np.unpackbits(p[:, None], axis=1, bitorder="little").mean(axis=0) for p in planes])[: len(languages)]
    return Model(languages, planes, fill**HASHES, number[max(sizes, key=lambda k: (sizes[k], k))])


_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def evidence(text: str, model: Model) -> np.ndarray:
    """By language: n-grams of the text that it contains, corrected for those by chance."""
    n, hits = 0, np.zeros(len(model.planes) * 8, np.int64)
    for h in ngrams(text):
        n += len(h)
        slots = _slots(h)
        for k, plane in enumerate(model.planes):
            mask = plane[slots[0]]
            for slot in slots[1:]:
                mask = mask & plane[slot]
            hits[8 * k : 8 * k + 8] += np.bincount(mask, minlength=256) @ _BITS
    chance = model.chance
    return np.maximum(0, (hits[: len(chance)] - n * chance) / np.maximum(1e-9, 1 - chance))


def identify(text: str | None, model: Model) -> tuple[str, float]:
    if not model.languages or not has_letter(text):
        return UNDETERMINED, 0.0
    found = evidence(text, model)
    if not found.any():
        return model.languages[model.usual], 0.0
    best = int(found.argmax())
    return model.languages[best], float(found[best] / found.sum())


def with_language(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score``, the language's share of the evidence.

    The prediction is a learned language: the one with most evidence, the first by code point
    of several, the most frequent one if there is no evidence (score 0). Null texts, texts
    without a letter, and all texts if nothing was learned, are ``und`` with score 0. Repeated
    rows and other columns pass as they are.
    """

    @F.pandas_udf("lang_pred string, score double")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame([identify(t, model) for t in batch], columns=["lang_pred", "score"])

    made = docs.withColumn("_found", predict(F.col(text_col)))
    return made.withColumn("lang_pred", F.col("_found.lang_pred")).withColumn("score", F.col("_found.score")).drop("_found")
