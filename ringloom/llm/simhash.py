"""SimHash near-duplicates, linked through tables of distances to pivots.

Every distinct fingerprint x gets its Hamming distances to many reference fingerprints: a base
pivot r, one pivot r ^ M for each of 32 disjoint two-bit masks M, and some random ones. By the
triangle inequality two fingerprints within d bits have no coordinate that differs by more
than d. The masked pivots also make the table an index: (|M| + |x,r| - |x,r^M|) / 2 is the
number of bits of x ^ r inside M, and because the masks are disjoint the differences of these
numbers add up to d at most. With the masks dealt into d + 4 groups at least 4 groups agree in
all their coordinates, so every link is found by an equi-join on some choice of 4 groups.
What meets there is discarded by its largest coordinate difference, and the rest is verified.
"""

from __future__ import annotations

import random
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ringloom.llm.common import cut_lineage, slices, text_key
from ringloom.llm.graph import components

MAX_BITS = 3
SHINGLE_WORDS = 3
MASK_BITS = 2
AGREEING = 4
RANDOM_PIVOTS = 16
CHUNK = 2048  # members of a bucket that one task compares with as many others
SEED = 42

_ROWS = 1 << 15


def fingerprint(text: str | None, words_in_shingle: int = SHINGLE_WORDS) -> int:
    """64 bits: each is the majority of that bit in the XXH64 of all word shingles."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    k = min(words_in_shingle, len(words))
    first, last = starts[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist()
    counts, digest = np.zeros(64, np.int64), xxhash.xxh64_intdigest
    for lo, hi in slices(len(first), _ROWS):
        hashes = [digest(joined[a:b], 42) for a, b in zip(first[lo:hi], last[lo:hi], strict=True)]
        as_bytes = np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(as_bytes, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * counts > len(first), bitorder="little")
    return int.from_bytes(bits.tobytes(), "little")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, key, fp): one row per row of ``docs``; fp is the fingerprint as a signed long."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            made = np.array([fingerprint(t) for t in frame["text"]], np.uint64).view(np.int64)
            yield pd.DataFrame({"doc_id": frame["doc_id"], "key": frame["key"], "fp": made})

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(
        F.col(id_col).alias("doc_id"), text_key(F.col(text_col)).alias("key"), F.col(text_col).alias("text")
    )
    # Ids travel as text: pandas would turn longs with nulls into floats.
    rows = rows.withColumn("doc_id", F.col("doc_id").cast("string"))
    return rows.mapInPandas(run, "doc_id string, key long, fp long").withColumn("doc_id", F.col("doc_id").cast(kind))


def pivots(mask_bits: int = MASK_BITS, extra: int = RANDOM_PIVOTS, seed: int = SEED) -> tuple[int, list[int], list[int]]:
    """The base pivot, the disjoint masks, and random pivots."""
    draw = random.Random(seed)
    base, order = draw.getrandbits(64), draw.sample(range(64), 64)
    masks = [sum(1 << b for b in order[i : i + mask_bits]) for i in range(0, 64, mask_bits)]
    return base, masks, [draw.getrandbits(64) for _ in range(extra)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def _distance(fp: Column, pivot: int) -> Column:
    return F.bit_count(fp.bitwiseXOR(F.lit(_signed(pivot))))


def _with_bucket(distinct: DataFrame, max_bits: int, mask_bits: int) -> DataFrame:
    """A row for each key of a fingerprint; two within ``max_bits`` share at least one key."""
    base, masks, _ = pivots(mask_bits)
    groups, width = max_bits + AGREEING, mask_bits.bit_length()
    fp, to_base = F.col("fp"), F.col("to_base")
    packed = {}
    for g in range(groups):
        value = F.lit(0).cast("long")
        for m in masks[g::groups]:
            inside = F.shiftright(F.lit(m.bit_count()) + to_base - _distance(fp, base ^ m), 1)
            value = F.shiftleft(value, width).bitwiseOR(inside.cast("long"))
        packed[f"g{g}"] = value
    keys = [F.xxhash64(F.lit(t), *some) for t, some in enumerate(combinations(packed, AGREEING))]
    rows = distinct.select("fp", _distance(fp, base).alias("to_base"))
    return rows.select("fp", *[v.alias(k) for k, v in packed.items()]).select("fp", F.explode(F.array(keys)).alias("bucket"))


def _forest(members: np.ndarray, table: np.ndarray, max_bits: int) -> list[tuple[int, int]]:
    """A spanning forest of the links among ``members``; table: their distances to the pivots."""
    found, left = [], np.arange(len(members))
    while len(left) > 1:
        seed, left = left[0], left[1:]
        frontier = [seed]
        while frontier and len(left):
            x = frontier.pop()
            near = np.abs(table[left] - table[x]).max(axis=1) <= max_bits
            if near.any():
                survivors = left[near]
                linked = survivors[np.bitwise_count(members[survivors] ^ members[x]) <= max_bits]
                if len(linked):
                    found += [(int(x), int(y)) for y in linked]
                    frontier += linked.tolist()
                    left = left[~np.isin(left, linked)]
    return found


def links(distinct: DataFrame, max_bits: int = MAX_BITS, mask_bits: int = MASK_BITS, chunk: int = CHUNK) -> DataFrame:
    """(a, b): edges that connect just what links of ``max_bits`` or fewer bits connect.

    ``distinct`` has each fingerprint (fp) once. A bucket of more than ``chunk`` members is cut
    into chunks in the order of a pivot distance and each pair of chunks is a task's work, so
    a task holds two chunks however many fingerprints agree; pairs of chunks whose distances
    to that pivot are too far apart are discarded whole. From each a spanning forest comes
    out, not all pairs.
    """
    base, masks, extra = pivots(mask_bits)
    near = [base, *extra]
    rows = _with_bucket(distinct, max_bits, mask_bits)
    in_bucket = Window.partitionBy("bucket")
    rows = rows.withColumn("n", F.count("*").over(in_bucket)).where("n > 1")
    rows = rows.withColumn("at", _distance(F.col("fp"), extra[0]))
    rows = rows.withColumn("part", F.floor((F.row_number().over(in_bucket.orderBy("at", "fp")) - 1) / chunk))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("n") / chunk) - 1)))
    pairs = (
        rows.groupBy("bucket", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"))
        .agg(
            F.collect_list("fp").alias("fps"),
            F.max(F.when(F.col("part") == F.least("part", "other"), F.col("at"))).alias("top"),
            F.min(F.when(F.col("part") == F.greatest("part", "other"), F.col("at"))).alias("bottom"),
        )
        .where(F.col("bottom") - F.col("top") <= max_bits)
        .select("fps")
    )

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reference = np.array(near, np.uint64)
        for frame in frames:
            a, b = [], []
            for fps in frame["fps"]:
                members = np.sort(np.asarray(fps, np.int64)).view(np.uint64)
                table = np.bitwise_count(members[:, None] ^ reference[None, :]).astype(np.int16)
                for x, y in _forest(members, table, max_bits):
                    a.append(members[x])
                    b.append(members[y])
            yield pd.DataFrame({"a": np.array(a, np.uint64).view(np.int64), "b": np.array(b, np.uint64).view(np.int64)})

    return pairs.mapInPandas(run, "a long, b long")


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_bits: int = MAX_BITS, mask_bits: int = MASK_BITS
) -> DataFrame:
    """(doc_id, key, fp, component_id) for every row of ``docs``.

    component_id is the smallest id that links reach, among ids that are not null (null if
    there is none). Null, empty and blank texts have fingerprint zero and link like others;
    repeated rows get a row each; other columns of ``docs`` play no part. No rows: no rows.
    """
    prints = cut_lineage(fingerprints(docs, id_col, text_col))
    distinct = cut_lineage(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id")))
    roots = components(links(distinct.select("fp"), max_bits, mask_bits))
    labelled = (
        distinct.join(roots, distinct["fp"] == roots["node"], "left")
        .select("fp", "first_id", F.coalesce("root", "fp").alias("root"))
    )
    classes = labelled.groupBy("root").agg(F.min("first_id").alias("component_id"))
    classes = labelled.join(classes, "root").select("fp", "component_id")
    return prints.join(classes, "fp").select("doc_id", "key", "fp", "component_id")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the row of the smallest id of each component.

    Rows that share an id are one document and stay or go together; a row without an id stays
    only if nothing in its component has one.
    """
    found = near_duplicates(docs, id_col, text_col)
    gone = found.where("component_id is not null and not (doc_id <=> component_id)")
    gone = gone.select(F.col("doc_id").alias("_id"), F.col("key").alias("_key")).distinct()
    match = docs[id_col].eqNullSafe(F.col("_id")) & (text_key(docs[text_col]) == F.col("_key"))
    return docs.join(gone, match, "left_anti")
