"""Collocations: frequent phrases counted level by level with double-array tries.

1. Texts are cut into words once and written as *shards*: rows (language, the shard's own words,
   their counts and numbers, and the words of its texts as 16-bit or 32-bit codes, the
   highest at the border of a piece). A shard is read from raw bytes with numpy; it is bounded in bytes and holds whole texts.
2. Words are summed over shards. The number of a word is a salted 64-bit hash of it and its language.
   All words are checked for numbers that coincide; should any, shards are made anew with
   another salt, so that numbers stand for words exactly and no table of words is in any task.
3. For each length k, candidates are the phrases seen in a text whose both parts of k-1 words
   are frequent (Apriori) and whose hash bucket was hit often enough. Both tests pass every frequent
   phrase; they are bitmaps of bounded size, so neither grows with the corpus.
4. Candidates go into a double-array trie (``base``, ``check``) over the digits of dense word codes, broadcast in
   rounds of a bounded number of phrases. In a task every position of a shard holds a state; all
   states advance together word by word, accepting states are counted with ``bincount``, and Spark
   sums shards. A phrase is in one round, so rounds add up.

Scores, the rule on longer phrases and the ranking are joins and aggregates over frequent phrases
only. Nothing is sampled, and hash buckets decide no count.

Null texts are empty, a null language is ``und``. Pieces end at ``.,;:!?``, line feed, vertical tab,
form feed and carriage return; words are what spaces and tabs separate. Repeated rows count again,
an empty table has no rows, other columns are left out. A text of any length is one row of a shard.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import count

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from ringloom.llm.common import cut_lineage
from ringloom.operators import sizing
from ringloom.operators.lineage import shared_folder

SHARD_BYTES = 3 << 20  # which seldom holds more words than 16 bits can number
ROUND_PHRASES = 1 << 18  # in one trie
LEAST_BITS, MOST_BITS = 20, 27  # of a bitmap, as powers of two
WORDS_PER_BUCKET = 8
TOP_SALTS = 64
BROADCAST_BYTES = 16 << 20  # as measured; the driver holds such a table several times while it sends it
RADIX = 512
BLOCK = 4096  # phrases whose counts travel in one row
FIRST_SALT = 0

END = b"\xff"  # is in no UTF-8 text: it ends one
_GAP, _BORDER = 1, 2
_KIND = np.zeros(256, np.uint8)
_KIND[list(b" \t")] = _GAP
_KIND[list(b".,;:!?\n\x0b\x0c\r" + END)] = _BORDER
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32


# Shards ---------------------------------------------------------------------------------


def word_codes(raw: memoryview) -> tuple[pa.Array, np.ndarray]:
    """(distinct words, code of each word in order with -1 wherever a new piece begins)."""
    kind = _KIND[np.frombuffer(raw, np.uint8)]
    inside = kind == 0
    data = _LOWER[np.frombuffer(raw, np.uint8)[inside]]
    edge = np.diff(inside.view(np.int8), prepend=np.int8(0), append=np.int8(0))
    start, stop = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    offsets = np.concatenate([[0], np.cumsum(stop - start)]).astype(np.int32)
    words = pa.BinaryArray.from_buffers(
        pa.binary(), len(start), [None, pa.py_buffer(offsets), pa.py_buffer(data.tobytes())]
    ).dictionary_encode()
    codes = words.indices.to_numpy(zero_copy_only=False).astype(np.int32)
    # How many borders lie before a word tells its piece.
    piece = np.searchsorted(np.flatnonzero(kind == _BORDER), start)
    return words.dictionary, np.insert(codes, np.flatnonzero(np.diff(piece)) + 1, -1)


_SHARDS = "lang string, words array<binary>, counts array<long>, codes binary"


def _shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of each language of a batch, cut where their texts pass ``SHARD_BYTES``."""
    for batch in batches:
        for lang in sorted(pc.unique(batch.column("lang")).to_pylist()):
            texts = batch.column("text").filter(pc.equal(batch.column("lang"), lang))
            ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False), dtype=np.int64)
            first = 0
            while first < len(texts):
                before = ends[first - 1] if first else 0
                last = max(first + 1, int(np.searchsorted(ends, before + SHARD_BYTES, side="right")))
                words, codes = word_codes(_bytes_of(texts[first:last]))
                counts = np.bincount(codes[codes >= 0], minlength=len(words))
                codes = codes.astype(_code_type(len(words))).tobytes()
                row = {"lang": [lang], "words": _one_row(words), "counts": _one_row(pa.array(counts)), "codes": [codes]}
                yield pa.record_batch(row)
                first = last


def _code_type(words: int) -> type:
    """Of the codes of a shard of so many words; the highest number is left for borders."""
    return np.uint16 if words < 0xFFFF else np.uint32


def _one_row(values: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(np.array([0, len(values)], np.int32), values)


def _bytes_of(texts: pa.Array) -> memoryview:
    """The bytes of consecutive texts, which lie one after the other."""
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int32)[texts.offset : texts.offset + len(texts) + 1]
    return memoryview(data)[at[0] : at[-1]]


def shards(docs: DataFrame, folder: str, salt: int) -> DataFrame:
    """Shards of ``docs`` (text, lang), written to ``folder`` and read again."""
    texts = docs.select(
        F.coalesce("lang", F.lit("und")).alias("lang"), F.concat(F.col("text").cast("binary"), F.lit(END)).alias("text")
    ).where(F.octet_length("text") > 1)
    numbers = F.transform("words", lambda w: F.xxhash64(F.lit(salt), "lang", w))
    texts.mapInArrow(_shard, _SHARDS).withColumn("numbers", numbers).write.parquet(folder)
    return docs.sparkSession.read.parquet(folder)


def word_counts(made: DataFrame, least: int) -> DataFrame:
    """(lang, id, f, word) over all shards; word is null if there are fewer than ``least``."""
    pairs = made.select("lang", F.explode(F.arrays_zip("words", "numbers", "counts")).alias("p"))
    words = pairs.groupBy("lang", F.col("p.words").alias("word"), F.col("p.numbers").alias("id")).agg(F.sum("p.counts").alias("f"))
    return words.select("lang", "id", "f", F.when(F.col("f") >= least, F.col("word")).alias("word"))


def _clashes(words: DataFrame) -> bool:
    """Whether two words have one number, or one the number 0, which stands for borders."""
    return not words.groupBy("id").count().where("count > 1 OR id = 0").isEmpty()


def _shards_of(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(numbers, codes) of each shard; borders have the number 0, which no phrase has."""
    for numbers, codes in zip(batch.column("numbers"), batch.column("codes"), strict=True):
        n, kind = len(numbers), _code_type(len(numbers))
        codes = np.frombuffer(codes.as_buffer(), kind)
        if kind is np.uint32:
            codes = np.minimum(codes, n)
        padded = np.zeros(max(n + 1, 1 << 16), np.int64)
        padded[:n] = numbers.values.to_numpy(zero_copy_only=False)
        yield padded, codes


# Bitmaps --------------------------------------------------------------------------------


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(29))


def _buckets(words: np.ndarray, at: np.ndarray, k: int, bits: int) -> np.ndarray:
    """Bucket of the ``k`` words from each position of ``at``."""
    h = np.full(len(at), k, np.uint64)
    for j in range(k):
        h = _mix(h * np.uint64(0x100000001B3) + words[at + j].astype(np.uint64))
    return (h >> np.uint64(64 - bits)).astype(np.int64)


def _page_bits(bits: int) -> int:
    """A bitmap has 512 pages, or as many more as keep places within a page to 16 bits."""
    return max(6, min(16, bits - 9))


def _bitmap(pages: DataFrame, bits: int) -> np.ndarray:
    """A bitmap from its pages (page, mask); what comes to the driver is bounded by the bitmap."""
    found = pages.toArrow()
    page_bits = _page_bits(bits)
    out = np.zeros((1 << (bits - page_bits), 1 << (page_bits - 6)), np.uint64)
    for page, mask in zip(found["page"].to_pylist(), found["mask"].to_pylist(), strict=True):
        out[page] = np.frombuffer(mask, np.uint64)
    return out.ravel()


def _paged(bucket: np.ndarray, page_bits: int) -> pa.RecordBatch:
    """Sorted hits of buckets as rows (page, places, hits), a row for each page that is hit."""
    start = np.flatnonzero(np.diff(bucket, prepend=-1))
    hits = np.diff(start, append=len(bucket)).astype(np.uint32)
    bucket = bucket[start]
    page, first = np.unique(bucket >> page_bits, return_index=True)
    edges = np.append(first, len(bucket)).astype(np.int32)

    def cut(values: np.ndarray) -> pa.Array:
        size = values.dtype.itemsize
        return pa.BinaryArray.from_buffers(pa.binary(), len(page), [None, pa.py_buffer(edges * size), pa.py_buffer(values.tobytes())])

    places = (bucket & ((1 << page_bits) - 1)).astype(np.uint16)
    return pa.record_batch({"page": page.astype(np.int32), "places": cut(places), "hits": cut(hits)})


def _merged(least: int, page_bits: int):
    """Sums the rows of each page, which come one after the other, to a mask of buckets with ``least``
    hits or more. A page is all that is held."""

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sums = None, np.zeros(1 << page_bits, np.int64)

        def mask() -> pa.RecordBatch:
            bits = np.packbits(sums >= least, bitorder="little").tobytes()
            return pa.record_batch({"page": pa.array([now], pa.int32()), "mask": [bits]})

        for batch in batches:
            for page, places, hits in zip(*(batch.column(c) for c in ("page", "places", "hits")), strict=True):
                if page.as_py() != now:
                    if now is not None:
                        yield mask()
                    now = page.as_py()
                    sums[:] = 0
                sums[np.frombuffer(places.as_buffer(), np.uint16)] += np.frombuffer(hits.as_buffer(), np.uint32)
        if now is not None:
            yield mask()

    return merge


def _masks(rows: DataFrame, least: int, bits: int) -> DataFrame:
    """(page, mask) from rows (page, places, hits) of any number of tasks."""
    return rows.repartition("page").sortWithinPartitions("page").mapInArrow(_merged(least, _page_bits(bits)), "page int, mask binary")


def _set(bitmap: np.ndarray, bucket: np.ndarray) -> np.ndarray:
    return (bitmap[bucket >> 6] >> (bucket & 63).astype(np.uint64)) & np.uint64(1) != 0


def _runs(alive: np.ndarray, k: int) -> np.ndarray:
    """Positions from which ``k`` follow each other that are ``alive``."""
    n = len(alive) - k + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    whole = alive[:n].copy()
    for j in range(1, k):
        whole &= alive[j : j + n]
    return np.flatnonzero(whole)


def _safe(numbers: np.ndarray, codes: np.ndarray, words: np.ndarray, k: int, bits: int, single: np.ndarray, parts: np.ndarray) -> np.ndarray:
    """Positions at which ``k`` words stand, each of which (``single``) and both parts of k-1 words of which
    (``parts``) may be frequent. Words are looked up once a shard, parts only where all words pass."""
    at = _runs(((numbers != 0) & _set(single, _buckets(numbers, np.arange(len(numbers)), 1, bits)))[codes], k)
    for shift in (0, 1) if k > 2 else ():
        at = at[_set(parts, _buckets(words, at + shift, k - 1, bits))]
    return at


def _array_of(phrases: np.ndarray) -> pa.Array:
    n, k = phrases.shape
    return pa.ListArray.from_arrays(np.arange(0, n * k + 1, k, dtype=np.int32), pa.array(phrases.ravel()))


_PAGES = "page int, places binary, hits binary"


def frequent_buckets(numbered: DataFrame, k: int, least: int, bits: int, single, parts) -> np.ndarray:
    """Bitmap of buckets hit at least ``least`` times by safe phrases of ``k`` words."""

    def hit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for numbers, codes in _shards_of(batch):
                words = numbers[codes]
                at = _safe(numbers, codes, words, k, bits, single.value, parts.value)
                bucket = _buckets(words, at, k, bits)
                if len(bucket):
                    yield _paged(np.sort(bucket), _page_bits(bits))

    return _bitmap(_masks(numbered.mapInArrow(hit, _PAGES), least, bits), bits)


def candidates(numbered: DataFrame, k: int, bits: int, single, parts, often) -> DataFrame:
    """(phrase): safe phrases of ``k`` words in buckets that are hit often, once each.

    A shard's phrases travel as one row for each page of the bitmap.
    """
    page_bits = _page_bits(bits)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for numbers, codes in _shards_of(batch):
                words = numbers[codes]
                at = _safe(numbers, codes, words, k, bits, single.value, parts.value)
                bucket = _buckets(words, at, k, bits)
                kept = _set(often.value, bucket)
                at, page = at[kept], bucket[kept] >> page_bits
                # Sorted by page, then by words: equal ones follow each other.
                found = np.stack([page, *(words[at + j] for j in range(k))])
                found = found[:, np.lexsort(found[::-1])]
                new = np.append(True, (np.diff(found) != 0).any(axis=0)) if len(at) else np.zeros(0, bool)
                found = found[:, new]
                pages, first = np.unique(found[0], return_index=True)
                blocks = [np.ascontiguousarray(b.T).tobytes() for b in np.split(found[1:], first[1:], axis=1)] if len(pages) else []
                yield pa.record_batch({"page": pages.astype(np.int32), "block": pa.array(blocks, pa.binary())})

    rows = numbered.mapInArrow(find, "page int, block binary").repartition("page").sortWithinPartitions("page")
    return rows.mapInArrow(_distinct(k), "phrase array<long>")


def _distinct(k: int):
    """(phrase) of each page's phrases, once each, from rows that come one after the other. What is
    held is the phrases of a page, of which there are at least 512."""

    def distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, size = None, [], 0

        def once() -> np.ndarray:
            return np.unique(np.concatenate(held), axis=0)

        for batch in batches:
            for page, block in zip(batch.column("page").to_pylist(), batch.column("block"), strict=True):
                if page != now:
                    if held:
                        yield pa.record_batch({"phrase": _array_of(once())})
                    now, held, size = page, [], 0
                held.append(np.frombuffer(block.as_buffer(), np.int64).reshape(-1, k))
                if sum(map(len, held[1:])) > max(10_000, 3 * size):
                    held = [once()]
                    size = len(held[0])
        if held:
            yield pa.record_batch({"phrase": _array_of(once())})

    return distinct


def bitmap_of(phrases: DataFrame, k: int, bits: int) -> np.ndarray:
    """Bitmap of phrases (phrase) of ``k`` words."""

    def hash_(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = batch.column("phrase").flatten().to_numpy(zero_copy_only=False)
            if len(words):
                yield _paged(np.sort(_buckets(words, np.arange(0, len(words), k), k, bits)), _page_bits(bits))

    return _bitmap(_masks(phrases.select("phrase").mapInArrow(hash_, _PAGES), 1, bits), bits)


# Double-array trie ------------------------------------------------------------------------


@dataclass(frozen=True)
class Trie:
    """``phrases`` (rows of word numbers, sorted) as a double array.

    A word is two symbols, the high and the low digit of its place in ``numbers`` plus one, so that
    the children of a state span at most ``RADIX`` slots. From state s symbol c leads to
    t = base[s] + c if check[t] == s. State 0 is the root; ``accepts[t]`` is a phrase's row or -1.
    """

    numbers: np.ndarray
    base: np.ndarray
    check: np.ndarray
    accepts: np.ndarray
    phrases: np.ndarray

    def count(self, numbers: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """Occurrences of each phrase in the words ``numbers[codes]``.

        The states of all positions advance together, symbol by symbol; a position whose state has
        no child leaves. Only positions of words that are all in phrases begin.
        """
        place = np.searchsorted(self.numbers, numbers)
        place[place == len(self.numbers)] = 0
        known = self.numbers[place] == numbers
        digits = [np.where(known, d + 1, 0) for d in np.divmod(place, RADIX)]
        at = _runs(known[codes], self.phrases.shape[1])
        state = np.zeros(len(at), np.int64)
        for depth in range(self.phrases.shape[1]):
            for digit in digits:
                symbol = digit[codes[at + depth]]
                onward = self.base[state] + symbol
                good = (symbol > 0) & (self.check[onward] == state)
                at, state = at[good], onward[good]
        return np.bincount(self.accepts[state], minlength=len(self.phrases))  # what is left accepts


def build_trie(phrases: np.ndarray) -> Trie:
    """Double array of distinct phrases of one length, without a loop over its nodes.

    Depth by depth, the nodes of several children that are still without a base try one each, drawn
    from a fixed seed, in room of twice their children. A node keeps it if no other node that tries
    wants one of its children's slots; nodes with more children win. While few succeed, those that
    are left move on to new room. Nodes of one child take the next free slot each, wherever it is.
    So slots stay a few times the edges, and what a driver and a task hold is bounded by a round.
    """
    phrases = phrases[np.lexsort(phrases.T[::-1])]
    numbers, place = np.unique(phrases, return_inverse=True)
    digits = np.divmod(place.reshape(phrases.shape).astype(np.int32), np.int32(RADIX))
    symbols = np.stack(digits, axis=2).reshape(len(phrases), -1) + np.int32(1)
    n, top = len(phrases), int(symbols.max()) + 1
    draw = np.random.default_rng(0)
    base, check = np.zeros(top, np.int32), np.full(top, -1, np.int32)
    check[0] = 0  # taken: the root is nobody's child
    node = np.zeros(n, np.int32)  # state of each phrase's prefix
    for symbol in symbols.T:
        first = np.ones(n, bool)
        first[1:] = (node[1:] != node[:-1]) | (symbol[1:] != symbol[:-1])
        parent, child = node[first], symbol[first]
        new = np.append(True, parent[1:] != parent[:-1])
        owner, group = parent[new], np.cumsum(new, dtype=np.int32) - 1
        width = np.bincount(group).astype(np.int32)
        waiting, few = width > 1, True
        while waiting.any():
            if few:
                room = len(check)
                base, check = _longer(base, check, 2 * int(width[waiting].sum()) + 2 * top)
            tries = draw.integers(room, len(check) - top, len(owner), np.int32)
            edge = np.flatnonzero(waiting[group])
            who = group[edge]
            slot = tries[who] + child[edge]
            claim = np.full(len(check) - room, -1, np.int32)
            order = np.lexsort((-who, width[who]))  # the last to write has the most children
            claim[slot[order] - room] = who[order]
            won = waiting.copy()
            won[who[(check[slot] >= 0) | (claim[slot - room] != who)]] = False
            mine = won[who]
            base[owner[won]] = tries[won]
            check[slot[mine]] = owner[who[mine]]
            few = won.sum() * 4 < waiting.sum()
            waiting &= ~won
        alone = np.flatnonzero((width == 1)[group])
        free = np.flatnonzero(check[top : len(check) - top] < 0)[: len(alone)] + top
        if len(free) < len(alone):
            base, check = _longer(base, check, len(alone) + top)
            free = np.flatnonzero(check[top : len(check) - top] < 0)[: len(alone)] + top
        base[parent[alone]] = free - child[alone]
        check[free] = parent[alone]
        node = (base[parent] + child)[np.cumsum(first) - 1]
    accepts = np.full(len(check), -1, np.int32)
    accepts[node] = np.arange(n)
    return Trie(numbers, base, check, accepts, phrases)


def _longer(base: np.ndarray, check: np.ndarray, more: int) -> tuple[np.ndarray, np.ndarray]:
    return np.append(base, np.zeros(more, np.int32)), np.append(check, np.full(more, -1, np.int32))


def count_phrases(numbered: DataFrame, phrases: DataFrame, least: int, round_phrases: int) -> DataFrame:
    """(phrase, f) of those ``phrases`` (phrase) that occur ``least`` times or more; a trie of at most about
    ``round_phrases`` a round."""
    spark = numbered.sparkSession
    rounds = max(1, -(-phrases.count() // round_phrases))
    counted = None
    for n in range(rounds):
        rows = phrases.where(F.pmod(F.xxhash64("phrase"), F.lit(rounds)) == n).toArrow()["phrase"].combine_chunks()
        if not len(rows):
            continue
        flat = rows.flatten().to_numpy(zero_copy_only=False)
        shared = spark.sparkContext.broadcast(build_trie(flat.reshape(len(rows), -1)))

        made = numbered.mapInArrow(_count(shared), "block int, hits binary").repartition("block").sortWithinPartitions("block")
        summed = made.mapInArrow(_sum(shared, least), "phrase array<long>, f long")
        counted = summed if counted is None else counted.unionByName(summed)
    if counted is None:
        return spark.createDataFrame([], "phrase array<long>, f long")
    return counted


def _count(shared):
    """Counts of a task's shards, as rows (block, hits) for ``BLOCK`` phrases each."""

    def count_(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, hits = shared.value, None
        for batch in batches:
            for numbers, codes in _shards_of(batch):
                counts = trie.count(numbers, codes)
                hits = counts if hits is None else hits + counts
        if hits is not None:
            blocks = range(0, len(hits), BLOCK)
            packed = [hits[b : b + BLOCK].astype(np.int64).tobytes() for b in blocks]
            yield pa.record_batch({"block": pa.array([b // BLOCK for b in blocks], pa.int32()), "hits": packed})

    return count_


def _sum(shared, least: int):
    """(phrase, f) of the phrases with ``least`` occurrences or more, from the rows of each block, which
    come one after the other. One block's sums are all that is held."""

    def sum_(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        phrases, now, sums = shared.value.phrases, None, None

        def often() -> pa.RecordBatch:
            some = np.flatnonzero(sums >= least)
            return pa.record_batch({"phrase": _array_of(phrases[now * BLOCK + some]), "f": sums[some]})

        for batch in batches:
            for block, hits in zip(batch.column("block").to_pylist(), batch.column("hits"), strict=True):
                hits = np.frombuffer(hits.as_buffer(), np.int64)
                if block == now:
                    sums += hits
                    continue
                if now is not None:
                    yield often()
                now, sums = block, hits.copy()
        if now is not None:
            yield often()

    return sum_


# Phrases --------------------------------------------------------------------------------


@F.pandas_udf(LongType())
def _score(a: pd.Series, n: pd.Series, l: pd.Series, r: pd.Series) -> pd.Series:
    """floor(1000 a n / (l r)) in whole numbers of any size. It is at most 1000 n / max(l, r)."""
    return pd.Series([1000 * w * x // (y * z) for w, x, y, z in zip(a.tolist(), n.tolist(), l.tolist(), r.tolist(), strict=True)])


def _lowest_cut(phrases: DataFrame, counts: DataFrame) -> DataFrame:
    """Adds l, r and score of each phrase's lowest-scoring cut."""
    sides = sizing.broadcast_if_small(counts, BROADCAST_BYTES)
    cuts = phrases.select("phrase", "a", "n", F.explode(F.sequence(F.lit(1), F.size("phrase") - 1)).alias("k"))
    cut = (
        cuts.withColumn("_left", F.expr("slice(phrase, 1, k)"))
        .withColumn("_right", F.expr("slice(phrase, k + 1, size(phrase) - k)"))
        .join(sides.select(F.col("phrase").alias("_left"), F.col("f").alias("l")), "_left")
        .join(sides.select(F.col("phrase").alias("_right"), F.col("f").alias("r")), "_right")
        .withColumn("score", _score("a", "n", "l", "r"))
    )
    lowest = cut.groupBy("phrase").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    return lowest.select("phrase", "cut.l", "cut.r", "cut.score")


def _covered(phrases: DataFrame, share: int) -> DataFrame:
    """(phrase) of those inside a longer one that has at least ``share`` percent of their count."""
    spans = phrases.where(F.size("phrase") > 2).select(
        "phrase", "a", F.explode(F.sequence(F.lit(2), F.size("phrase") - 1)).alias("width")
    )
    places = spans.select("phrase", "a", "width", F.explode(F.expr("sequence(1, size(phrase) - width + 1)")).alias("at"))
    inner = places.groupBy(F.expr("slice(phrase, at, width)").alias("phrase")).agg(F.max("a").alias("longer"))
    both = inner.join(phrases.select("phrase", "a"), "phrase")
    return both.where(F.lit(100) * F.col("longer") >= F.lit(share) * F.col("a")).select("phrase")


def _said(phrases: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(phrase, lang, text) with the words of each phrase."""
    words = phrases.select("phrase", F.posexplode("phrase").alias("at", "id"))
    named = words.join(sizing.broadcast_if_small(vocabulary.select("id", "lang", "word"), BROADCAST_BYTES), "id")
    in_order = F.transform(F.array_sort(F.collect_list(F.struct("at", F.col("word").cast("string").alias("w")))), lambda p: p["w"])
    return named.groupBy("phrase").agg(F.first("lang").alias("lang"), F.array_join(in_order, " ").alias("text"))


def _best(rows: DataFrame, top: int) -> DataFrame:
    """The first ``top`` of each language. First within salts, so that no task ranks a language."""
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    salt = F.pmod(F.xxhash64("phrase"), F.lit(TOP_SALTS))
    part = Window.partitionBy("lang", "_salt").orderBy(*order)
    kept = rows.withColumn("_salt", salt).withColumn("_n", F.row_number().over(part)).where(F.col("_n") <= top)
    whole = Window.partitionBy("lang").orderBy(*order)
    return kept.drop("_salt", "_n").withColumn("rank", F.row_number().over(whole).cast("long")).where(F.col("rank") <= top)


def frequent_phrases(
    docs: DataFrame,
    longest: int = 5,
    least: int = 100,
    round_phrases: int = ROUND_PHRASES,
    bits: int | None = None,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(phrase, f) of all phrases of 1 to ``longest`` words with ``least`` occurrences or more,
    (lang, word, f, id) of the frequent words and (lang, n) of all words.

    A phrase is an array of word numbers; numbers of languages differ. ``bits`` sets the size of the
    bitmaps, by default about one bit for ``WORDS_PER_BUCKET`` words, up to 16 MB; beyond that
    they let more candidates through, which takes more rounds and changes no count.
    """
    spark = docs.sparkSession
    folder = f"{shared_folder(spark).rstrip('/')}/collocations-{uuid.uuid4().hex}"
    for salt in count(FIRST_SALT):
        made = shards(docs, f"{folder}/{salt}", salt)
        words = cut_lineage(word_counts(made, least))
        if not _clashes(words):
            break
    totals = words.groupBy("lang").agg(F.sum("f").alias("n"))
    vocabulary = words.where(F.col("f") >= least)
    numbered = made.select("numbers", "codes")
    if bits is None:
        n = words.agg(F.coalesce(F.sum("f"), F.lit(0))).first()[0]
        bits = min(MOST_BITS, max(LEAST_BITS, (n // WORDS_PER_BUCKET).bit_length()))
    counts = vocabulary.select(F.array("id").alias("phrase"), "f")
    single = parts = spark.sparkContext.broadcast(bitmap_of(counts, 1, bits))
    for k in range(2, longest + 1):
        often = spark.sparkContext.broadcast(frequent_buckets(numbered, k, least, bits, single, parts))
        tried = cut_lineage(candidates(numbered, k, bits, single, parts, often))
        level = cut_lineage(count_phrases(numbered, tried, least, round_phrases))
        counts = counts.unionByName(level)
        if k < longest:
            parts = spark.sparkContext.broadcast(bitmap_of(level, k, bits))
    return counts, vocabulary, totals


def mine(
    docs: DataFrame,
    longest: int = 5,
    least: int = 100,
    share: int = 100,
    top: int = 2000,
    round_phrases: int = ROUND_PHRASES,
    bits: int | None = None,
) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's first ``top`` collocations.

    ``a`` counts the phrase, ``l`` and ``r`` the two sides of its lowest-scoring cut, ``n`` all words
    of the language. A phrase inside a longer one with at least ``share`` percent of its count is
    dropped; ``top`` is the feature, not a bound on work.
    """
    counts, vocabulary, totals = frequent_phrases(docs, longest, least, round_phrases, bits)
    phrases = counts.where(F.size("phrase") > 1).withColumnRenamed("f", "a")
    kept = phrases.join(_covered(phrases, share), "phrase", "left_anti")
    said = cut_lineage(kept.join(_said(kept, vocabulary), "phrase").join(sizing.broadcast_if_small(totals), "lang"))
    scored = said.join(_lowest_cut(said, counts), "phrase")
    best = _best(scored.select("lang", F.col("text").alias("phrase"), "a", "l", "r", "n", "score"), top)
    return best.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")

