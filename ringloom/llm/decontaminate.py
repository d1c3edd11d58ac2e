"""Benchmark decontamination: windows of benchmark words found in training documents.

The windows of all items, normalised, are a hash set of n-grams that every task holds. A document is
read and cut into words once; the words from every place on, as many as windows have, are
hashed and looked up, and what meets a hash is compared with the n-gram, so each hit is verified
and no window is missed. The same scan counts the words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ringloom.llm.common import ascii_lower, cut_lineage, digest_of, text_key

WINDOW = 13
NOT_WORD = r"\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F"  # ASCII but for digits and letters
BETWEEN, WORD = f"[{NOT_WORD}]+", f"[^{NOT_WORD}]+"
MAX_BROADCAST_BYTES = 64 << 20


def words(text: Column) -> Column:
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), BETWEEN), "")


def benchmark_windows(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """(item, gram, len, h): every window of every item; gram has its words, h is their hash."""
    items = benchmark.select(F.coalesce(F.col(id_col).cast("string"), F.lit("null")).alias("item"), words(F.col(text_col)).alias("w"))
    n = F.size("w")
    starts = F.sequence(F.lit(1), F.greatest(n - window + 1, F.lit(1)))
    grams = items.where(n > 0).select("item", F.explode(F.transform(starts, lambda i: F.slice("w", i, window))).alias("g"))
    return grams.select("item", F.array_join("g", " ").alias("gram"), F.size("g").alias("len"), F.xxhash64("g").alias("h")).distinct()


def _starts(rows: DataFrame, lengths: list[int]) -> DataFrame:
    """A row (..., len, start, h) for each place in ``w`` and each length of a window: the hash of so
    many words. A document without a place has one row, without a hash; the first row of each
    document, and no other, has ``first``."""

    def hashes(length: int) -> Column:
        places = F.sequence(F.lit(1), F.greatest(F.size("w") - length + 1, F.lit(1)))
        # Of too few words for the length the hash is that of fewer, and no window's of this length.
        return F.transform(places, lambda i: F.xxhash64(F.slice("w", i, length)))

    each = F.array(*[hashes(n) for n in lengths]) if lengths else F.lit(None).cast("array<array<bigint>>")
    # The outer forms add no condition on the words, which would cut the text once more.
    per_length = rows.select("*", F.posexplode_outer(each).alias("which", "hs"))
    length = F.element_at(F.array(*[F.lit(n) for n in lengths or [0]]), F.coalesce("which", F.lit(0)) + 1)
    placed = per_length.select(*rows.columns, "which", length.alias("len"), F.posexplode_outer("hs").alias("start", "h"))
    first = (F.coalesce("which", F.lit(0)) == 0) & (F.coalesce("start", F.lit(0)) == 0)
    return placed.withColumn("first", first).drop("which")


def _equal(grams: str, words_: str = "w") -> Column:
    """Those of an array of n-grams that stand at ``start``."""
    there = F.array_join(F.slice(words_, F.col("start") + 1, F.col("len")), " ")
    return F.filter(grams, lambda g: g == there)


def _scan(docs: DataFrame, windows: DataFrame, id_col: str, text_col: str, max_broadcast_bytes: int) -> DataFrame:
    """(doc_id, key, n_words, first, start, len, grams): the first row of every document and every
    place where n-grams stand; where only their hash does, grams is empty.

    The n-grams are broadcast if, counted, they fit ``max_broadcast_bytes``: one scan, no shuffle.
    Otherwise hashes of places meet those of windows in a shuffle, without texts, and only documents
    with a hash in common are read again to compare words.
    """
    grams = windows.select("gram", "len", "h").distinct()
    sizes = grams.groupBy("len").agg(F.sum(F.octet_length("gram") + 64).alias("b")).collect()
    lengths = sorted(r["len"] for r in sizes)
    by_hash = grams.groupBy("h").agg(F.collect_list("gram").alias("grams"))
    rows = docs.select(F.col(id_col).alias("doc_id"), text_key(F.col(text_col)).alias("key"), words(F.col(text_col)).alias("w"))
    rows = rows.withColumn("n_words", F.size("w").cast("long"))
    none = F.array().cast("array<string>")
    found = ["doc_id", "key", "n_words", "first", "start", "len"]
    if sum(r["b"] for r in sizes) <= max_broadcast_bytes:
        met = _starts(rows, lengths).join(F.broadcast(by_hash), "h", "left")
        # This condition alone: with one on the words beside it, words would be copied for every place.
        met = met.where(F.col("first") | F.col("grams").isNotNull())
        return met.select(*found, F.when(F.col("grams").isNotNull(), _equal("grams")).otherwise(none).alias("grams"))
    plain = rows.select("doc_id", "key", "n_words", F.lit(True).alias("first"), F.lit(0).alias("start"), F.lit(0).alias("len"), none.alias("grams"))
    places = _starts(rows, lengths).select("doc_id", "key", "start", "len", "h").distinct()
    met = cut_lineage(places.join(by_hash, "h").drop("h"))
    texts = rows.select(F.col("doc_id").alias("_id"), F.col("key").alias("_key"), "w")
    some = met.select(F.col("doc_id").alias("_i"), F.col("key").alias("_k")).distinct()
    texts = texts.join(some, F.col("_id").eqNullSafe(F.col("_i")) & (F.col("_key") == F.col("_k")), "left_semi").dropDuplicates(["_id", "_key"])
    met = met.join(texts, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("key") == F.col("_key")))
    met = met.select("doc_id", "key", F.lit(0).cast("long").alias("n_words"), F.lit(False).alias("first"), "start", "len", _equal("grams").alias("grams"))
    return plain.unionByName(met.where(F.size("grams") > 0))


def find_hits(
    docs: DataFrame,
    windows: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    max_broadcast_bytes: int = MAX_BROADCAST_BYTES,
) -> DataFrame:
    """(doc_id, key, start, len, gram): occurrences of windows, by the place of their first word."""
    return _hits(_scan(docs, windows, id_col, text_col, max_broadcast_bytes))


def _hits(scanned: DataFrame) -> DataFrame:
    return scanned.select("doc_id", "key", "start", "len", F.explode("grams").alias("gram"))


def contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    window: int = WINDOW,
    max_broadcast_bytes: int = MAX_BROADCAST_BYTES,
) -> DataFrame:
    """(doc_id, key, n_words, n_hit, n_items, items_sha256, contaminated) for every row of ``docs``.

    A null text has no words, and neither hits nor is hit. Items of equal text all count; rows
    that repeat an item's id are one item, items without an id are one item called ``null``.
    Repeated documents get a row each. Texts may be of any length. An empty benchmark or no documents: no
    hits, no rows.
    """
    windows = benchmark_windows(benchmark, item_col, item_text_col, window)
    scanned = cut_lineage(_scan(docs, windows, id_col, text_col, max_broadcast_bytes))
    hits = _hits(scanned).distinct()
    row = ["doc_id", "key"]
    in_order = Window.partitionBy(*row).orderBy("start", "len").rowsBetween(Window.unboundedPreceding, -1)
    end = F.col("start") + F.col("len")
    covered = F.coalesce(F.max(end).over(in_order), F.lit(0))
    hit_words = (
        hits.select(*row, "start", "len").distinct()
        .withColumn("new", F.greatest(F.lit(0), end - F.greatest(F.col("start"), covered)))
        .groupBy(*row).agg(F.sum("new").alias("n_hit"))
    )
    found = hits.select(*row, "gram").distinct().join(windows.select("gram", "item").distinct(), "gram")
    items = found.groupBy(*row).agg(F.array_sort(F.collect_set("item")).alias("items"))
    per_doc = hit_words.select(F.col("doc_id").alias("_id"), F.col("key").alias("_key"), "n_hit").join(
        items.select(F.col("doc_id").alias("_id2"), F.col("key").alias("_key2"), "items"),
        F.col("_id").eqNullSafe(F.col("_id2")) & (F.col("_key") == F.col("_key2")),
    )
    rows = scanned.where("first").select(*row, "n_words").join(per_doc, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("key") == F.col("_key")), "left")
    n_hit = F.coalesce("n_hit", F.lit(0))
    return rows.select(
        *row,
        "n_words",
        n_hit.cast("long").alias("n_hit"),
        F.when(F.col("items").isNull(), 0).otherwise(F.size("items")).cast("long").alias("n_items"),
        digest_of(F.col("items")).alias("items_sha256"),
        ((n_hit > 0) & (20 * n_hit >= F.col("n_words"))).alias("contaminated"),
    )


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without contaminated documents, all columns kept."""
    bad = contamination(docs, benchmark, id_col, text_col).where("contaminated")
    bad = bad.select(F.col("doc_id").alias("_id"), F.col("key").alias("_key")).distinct()
    match = docs[id_col].eqNullSafe(F.col("_id")) & (text_key(docs[text_col]) == F.col("_key"))
    return docs.join(bad, match, "left_anti")


def remove_spans(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the words that benchmark windows hit, and what follows each, cut out of the text."""
    hits = find_hits(docs, benchmark_windows(benchmark), id_col, text_col)
    hit = F.explode(F.sequence(F.col("start"), F.col("start") + F.col("len") - 1))
    cut = hits.select("doc_id", "key", hit.alias("n")).groupBy("doc_id", "key").agg(F.collect_set("n").alias("_cut"))
    cut = cut.select(F.col("doc_id").alias("_id"), F.col("key").alias("_key"), "_cut")
    match = docs[id_col].eqNullSafe(F.col("_id")) & (text_key(docs[text_col]) == F.col("_key"))
    text = docs[text_col]
    parts = F.regexp_extract_all(text, F.lit(f"{WORD}[{NOT_WORD}]*"), F.lit(0))
    head = F.regexp_extract(text, f"^[{NOT_WORD}]*", 0)
    rest = F.filter(parts, lambda _, i: ~F.array_contains("_cut", i))
    made = F.when(F.col("_cut").isNull(), text).otherwise(F.concat(head, F.array_join(rest, "")))
    joined = docs.join(cut, match, "left")
    return joined.select(*[made.alias(c) if c == text_col else docs[c] for c in docs.columns])
