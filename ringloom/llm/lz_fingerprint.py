"""Document fingerprints from Lempel-Ziv phrases.

A text is parsed into dictionary phrases: each is the longest phrase met before and one more
character. The phrases are hashed, and the least hashes are the fingerprint; the share of
least hashes that two fingerprints have in common estimates the likeness of their phrase sets,
as a joint dictionary would in compression.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ringloom.llm.common import text_key

SIGNATURE = 64  # least hashes kept
_BASE = 0x5851F42D4C957F2D  # odd, so it has an inverse modulo 2**64
_NO_ID = -(1 << 63)


def parse(text: str, at: int, known: set[str], ends: list[int]) -> int:
    """Adds the phrases of text[at:] to ``known`` and where they end to ``ends``; where the
    unfinished one starts.

    Every beginning of a known phrase is known, so the longest match is found from a guess by
    steps up or down; the guess is the length of the phrase before.
    """
    size, end, add, note = 3, len(text), known.add, ends.append
    while at < end:
        phrase = text[at : at + size]
        if phrase in known:
            size += 1
            phrase = text[at : at + size]
            while phrase in known and at + size <= end:
                size += 1
                phrase = text[at : at + size]
            if at + size > end:
                break
        else:
            size = len(phrase)
            while size > 1:
                shorter = text[at : at + size - 1]
                if shorter in known:
                    break
                phrase = shorter
                size -= 1
        add(phrase)
        at += size
        note(at)
    return at


class _Powers:
    """Powers of the base and of its inverse, as far as texts have needed them."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    @staticmethod
    def _powers(x: int, n: int) -> np.ndarray:
        factors = np.full(n, x, np.uint64)
        factors[0] = 1
        return np.cumprod(factors, dtype=np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            self.up, self.down = (self._powers(x, 2 * n) for x in (_BASE, pow(_BASE, -1, 1 << 64)))
        return self.up, self.down


def least_hashes(text: str, ends: list[int], powers: _Powers) -> np.ndarray:
    """The least distinct 32-bit hashes of the consecutive phrases of ``text`` that end at ``ends``."""
    if not ends:
        return np.zeros(0, np.uint32)
    codes = np.frombuffer(text[: ends[-1]].encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + np.uint64(1)
    up, down = powers.upto(len(codes) + 1)
    sums = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum(codes * up[: len(codes)], out=sums[1:])
    stop = np.array(ends, np.int64)
    start = np.concatenate((np.zeros(1, np.int64), stop[:-1]))
    h = (sums[stop] - sums[start]) * down[start] + (stop - start).astype(np.uint64)
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    h = (h >> np.uint64(32)).astype(np.uint32)
    spare = 2 * SIGNATURE  # enough unless very many hashes are equal
    if len(h) > 2 * spare:
        some = _distinct(np.sort(np.partition(h, spare)[:spare]))
        if len(some) >= SIGNATURE:
            return some
    return _distinct(np.sort(h))


def _distinct(sorted_: np.ndarray) -> np.ndarray:
    new = np.ones(len(sorted_), bool)
    new[1:] = sorted_[1:] != sorted_[:-1]
    return sorted_[new][:SIGNATURE]


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """The share, among the least hashes of both together, of those that both have; 1 for two empty."""
    both = np.sort(np.concatenate((a, b)))
    union = _distinct(both)
    if not len(union):
        return 1.0
    shared = both[1:][both[1:] == both[:-1]]
    return float(np.searchsorted(shared, union[-1], side="right") / len(union))


def as_text(print_: np.ndarray) -> str:
    return print_.astype(">u4").tobytes().hex()


class Parsed:
    """A text's fingerprint, and the dictionary as it stands where its last third begins."""

    def __init__(self, text: str, powers: _Powers):
        self.text, self.powers, self.known, ends = text, powers, set(), []
        self.cut = len(text) - len(text) // 3
        self.at = parse(text[: self.cut], 0, self.known, ends)
        self.least = least_hashes(text, ends, powers)
        self.print = self._with_tail(text[self.at :])

    def _with_tail(self, tail: str) -> np.ndarray:
        """The fingerprint if ``tail`` follows the phrases before the cut."""
        ends: list[int] = []
        parse(tail, 0, self.known, ends)
        self.known.difference_update([tail[a:b] for a, b in zip([0, *ends], ends)])  # noqa: B905
        return _distinct(np.sort(np.concatenate((self.least, least_hashes(tail, ends, self.powers)))))

    def edited(self, other: str) -> tuple[str, np.ndarray]:
        """The text with its last third replaced by as much of the start of ``other``; its fingerprint."""
        tail = self.text[self.at : self.cut] + other[: len(self.text) - self.cut]
        return self.text[: self.at] + tail, self._with_tail(tail)


def fingerprint(text: str | None) -> np.ndarray:
    return Parsed(text or "", _Powers()).print


def _dealt(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(chunk, trailer, id, doc_id, key, text): the documents in chunks of consecutive ids.

    As many chunks as the square root of the number of documents, from quantiles of the ids.
    The first document of a chunk also trails the chunk before (that of the first chunk the
    last one), so that in every chunk each document is followed by the next.
    """
    rows = docs.select(
        F.coalesce(F.col(id_col).cast("long"), F.lit(_NO_ID)).alias("id"),
        F.col(id_col).alias("doc_id"),
        text_key(F.col(text_col)).alias("key"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"),
    )
    n = rows.count()
    chunks = max(1, int(n**0.5))
    marks = [i / chunks for i in range(1, chunks)] + [1.0]
    found = rows.agg(F.max("id"), F.percentile_approx("id", marks, max(10_000, 10 * chunks))).first()
    first = np.array(sorted({found[0] or 0, *(found[1] or [])}, reverse=True), np.int64)

    @F.pandas_udf("chunk int, leads boolean")
    def place(ids: pd.Series) -> pd.DataFrame:
        values = ids.to_numpy(np.int64)
        chunk = len(first) - np.searchsorted(first[::-1], values, side="left") - 1
        return pd.DataFrame({"chunk": chunk.astype(np.int32), "leads": first[chunk] == values})

    rows = rows.withColumn("at", place("id"))
    here = F.struct(F.col("at.chunk").alias("chunk"), F.lit(0).alias("trailer"))
    before = F.struct(F.pmod(F.col("at.chunk") - 1, F.lit(len(first))).alias("chunk"), F.lit(1).alias("trailer"))
    rows = rows.withColumn("to", F.explode(F.when(F.col("at.leads"), F.array(here, before)).otherwise(F.array(here))))
    return rows.select("to.chunk", "to.trailer", "id", "doc_id", "key", "text")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next)
    for every row of ``docs``.

    The next document is that of the next smaller id (rows without an id come last, rows of the
    same id by a hash of their texts; after the last comes the first; one document alone is its
    own next). The edited text has the last third, rounded down, replaced by as many first
    characters of the next document, or all it has. A fingerprint is in hex, eight digits a
    hash; null and empty texts have an empty one, and two empty ones are alike. Ids are whole
    numbers. Other columns of ``docs`` play no part. No rows: no rows.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    rows = _dealt(docs, id_col, text_col).withColumn("doc_id", F.col("doc_id").cast("string"))
    # Texts move once, into partitions of whole chunks in which they stand in order.
    rows = rows.repartition("chunk").sortWithinPartitions("chunk", "trailer", F.col("id").desc(), "key")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        powers, held, held_id, chunk = _Powers(), None, None, None
        for frame in frames:
            made = []
            for c, trailer, doc_id, text in zip(frame["chunk"], frame["trailer"], frame["doc_id"], frame["text"], strict=True):
                if c != chunk:
                    held, chunk = None, c
                elif held is None:
                    continue  # a second trailer
                now = Parsed(text, powers)
                if held is not None:
                    edited, edited_print = held.edited(text)
                    made.append((
                        held_id, len(held.text), hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(),
                        as_text(held.print), as_text(edited_print), likeness(held.print, edited_print), likeness(held.print, now.print),
                    ))
                held, held_id = (None, None) if trailer else (now, doc_id)
            yield pd.DataFrame(made, columns=names)

    schema = "doc_id string, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    names = [x.split()[0] for x in schema.split(", ")]
    return rows.mapInPandas(run, schema).withColumn("doc_id", F.col("doc_id").cast(kind))
