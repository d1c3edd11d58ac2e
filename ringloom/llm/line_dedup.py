"""Line dedup by a segment-partition edit join.

Two lines within d edits share, cut into d + 1 segments, at least one segment of the shorter
as a substring of the longer, near the same place. A line indexes its own segments and, as
the longer one, probes the places where a segment of a line up to d shorter can stand: the
key is (length, segment number, substring). What meets under a key is verified with banded
bit-parallel edit distance. Copies of a line are one line, by their MD5.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ringloom.llm.common import cut_lineage, text_key
from ringloom.llm.graph import components

MAX_EDITS = 2
MIN_CHARS = 30
CHARS_PER_EDIT = 10  # of a short line: it is allowed an edit for each so many characters
CHUNK = 256  # members of a bucket that one task compares with as many others
RECENT = 200_000  # lines that a task remembers, so as not to index copies again


def segments(length: int, n: int) -> list[tuple[int, int]]:
    """(start, length) of ``n`` nearly equal pieces, the shorter ones first."""
    small, longer = divmod(length, n)
    made, at = [], 0
    for i in range(n):
        size = small + (i >= n - longer)
        made.append((at, size))
        at += size
    return made


def places(length: int, max_edits: int) -> list[tuple[int, int, int, int, bool]]:
    """(indexed length, segment number, start, size, own) of the substrings a line stands under.

    For a segment at p of a line shorter by gap, edits to its left and to its right are both
    bounded by what pigeonholing leaves, so a start p + shift needs |shift| <= i on the left
    and |shift - gap| <= d - i on the right.
    """
    made = []
    for gap in range(min(max_edits, length - max_edits - 1) + 1):
        for i, (p, size) in enumerate(segments(length - gap, max_edits + 1)):
            low = max(0, p - i, p + gap - (max_edits - i))
            high = min(length - size, p + i, p + gap + (max_edits - i))
            made += [(length - gap, i, at, size, gap == 0 and at == p) for at in range(low, high + 1)]
    return made


def allowed(length: int, max_edits: int, chars_per_edit: int = CHARS_PER_EDIT) -> int:
    """The edits that a pair of lines may be apart whose longer one has ``length`` characters."""
    return min(max_edits, length // chars_per_edit)


def stands(length: int, max_edits: int, chars_per_edit: int = CHARS_PER_EDIT) -> list[tuple[int, int, int, int, int, bool]]:
    """(edits, indexed length, segment number, start, size, own): ``places`` for the edits that the
    line is allowed, and its own segments once more for each other number of edits that a longer
    line it may be linked to is allowed.
    """
    edits = allowed(length, max_edits, chars_per_edit)
    made = [(edits, *x) for x in places(length, edits)] if edits else []
    for more in sorted({allowed(length + gap, max_edits, chars_per_edit) for gap in range(1, max_edits + 1)} - {edits}):
        if length > more and allowed(length + more, max_edits, chars_per_edit) >= more:
            made += [(more, length, i, at, size, True) for i, (at, size) in enumerate(segments(length, more + 1))]
    return made


def common_prefix(a: str, b: str) -> int:
    lo, hi = 0, min(len(a), len(b))
    while lo < hi:
        mid = (lo + hi + 1) // 2
        if a[lo:mid] == b[lo:mid]:
            lo = mid
        else:
            hi = mid - 1
    return lo


def within_edits(a: str, b: str, most: int) -> bool:
    """Whether the edit distance is ``most`` or less.

    Bit-parallel over a band: after i characters of ``a``, bit k of ``reach[e]`` says that a[:i]
    and b[:i + k - most] are e edits apart or fewer. Only the 2 * most + 1 diagonals that can
    end within the bound are kept, and it stops when none is left. Equal ends are cut first.
    """
    if abs(len(a) - len(b)) > most:
        return False
    n = common_prefix(a, b)
    a, b = a[n:][::-1], b[n:][::-1]
    n = common_prefix(a, b)
    a, b = a[n:], b[n:]
    if not a or not b:
        return max(len(a), len(b)) <= most
    width = (1 << (2 * most + 1)) - 1
    reach = [(((1 << (e + 1)) - 1) << most) & width for e in range(most + 1)]
    for i, c in enumerate(a):
        same = exists = 0
        for k in range(2 * most + 1):
            j = i + k - most
            if -1 <= j < len(b):
                exists |= 1 << k
                if j >= 0 and b[j] == c:
                    same |= 1 << k
        before, reach[0] = reach[0], reach[0] & same
        for e in range(1, most + 1):
            moved = (reach[e] & same) | before | (before >> 1) | (reach[e - 1] << 1)
            before, reach[e] = reach[e], moved & exists
        if not reach[most]:
            return False
    return bool(reach[most] >> (most + len(b) - len(a)) & 1)


def lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, key, line_no, line) of every line; a null text has one empty line."""
    split = F.split(F.coalesce(F.col(text_col), F.lit("")), "\n", -1)
    rows = docs.select(F.col(id_col).alias("doc_id"), text_key(F.col(text_col)).alias("key"), split.alias("lines"))
    return rows.select("doc_id", "key", F.posexplode("lines").alias("line_no", "line"))


def _identity(column: str = "line"):
    return F.md5(F.col(column).cast("binary"))


def _buckets(long_lines: DataFrame, max_edits: int, chars_per_edit: int) -> DataFrame:
    """(bucket, line_id, own): what each line stands under."""
    from hashlib import md5

    import numpy as np
    import xxhash

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        digest, layout, seen = xxhash.xxh64_intdigest, {}, set()
        for frame in frames:
            for low in range(0, len(frame), 4096):
                keys, ids, own = [], [], []
                for line in frame["line"].iloc[low : low + 4096]:
                    raw = line.encode("utf-8", "surrogatepass")
                    line_id = int.from_bytes(md5(raw).digest()[:8], "big")
                    if line_id in seen:
                        continue
                    if len(seen) >= RECENT:
                        seen.clear()
                    seen.add(line_id)
                    n = len(line)
                    spots = layout.get(n)
                    if spots is None:
                        if len(layout) > 20_000:
                            layout.clear()
                        spots = layout[n] = stands(n, max_edits, chars_per_edit)
                    if len(raw) == n:  # ASCII: bytes and characters stand at the same places
                        keys += [digest(raw[at : at + size], (e << 40) + m * 8 + i) for e, m, i, at, size, _ in spots]
                    else:
                        keys += [digest(line[at : at + size].encode("utf-8", "surrogatepass"), (e << 40) + m * 8 + i) for e, m, i, at, size, _ in spots]
                    own += [x[5] for x in spots]
                    ids += [line_id] * len(spots)
                yield pd.DataFrame({
                    "bucket": np.array(keys, np.uint64).view(np.int64),
                    "line_id": np.array(ids, np.uint64).view(np.int64),
                    "own": np.array(own, bool),
                })

    return long_lines.select("line").mapInPandas(run, "bucket long, line_id long, own boolean")


def _once(long_lines: DataFrame) -> DataFrame:
    """(line, line_id): copies of a line that a task remembers are left out, so that one which is
    everywhere comes about once from each task and not in all its copies to one."""
    from hashlib import md5

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: set[int] = set()
        for frame in frames:
            lines, ids = [], []
            for line in frame["line"]:
                line_id = int.from_bytes(md5(line.encode("utf-8", "surrogatepass")).digest()[:8], "big", signed=True)
                if line_id not in seen:
                    if len(seen) >= RECENT:
                        seen.clear()
                    seen.add(line_id)
                    lines.append(line)
                    ids.append(line_id)
            yield pd.DataFrame({"line": lines, "line_id": ids})

    return long_lines.select("line").mapInPandas(run, "line string, line_id long")


def links(long_lines: DataFrame, max_edits: int = MAX_EDITS, chunk: int = CHUNK, *, chars_per_edit: int = CHARS_PER_EDIT) -> DataFrame:
    """(a, b): pairs of MD5s of lines within the edits that are allowed; none is left out.

    ``long_lines`` has a column ``line``. Allowed are ``max_edits``, or fewer if the longer line
    has not ``chars_per_edit`` characters for each. Lines travel as 64-bit handles until a bucket holds two; only then are texts fetched. A bucket of more
    than ``chunk`` members is cut into chunks, and each pair of chunks is a unit of work.
    """
    rows = _buckets(long_lines, max_edits, chars_per_edit)
    in_bucket = Window.partitionBy("bucket")
    met = rows.withColumn("lo", F.min("line_id").over(in_bucket)).withColumn("hi", F.max("line_id").over(in_bucket))
    met = met.withColumn("indexed", F.max("own").over(in_bucket)).where("lo <> hi and indexed")
    met = cut_lineage(met.groupBy("bucket", "line_id").agg(F.max("own").alias("own")))
    order = Window.partitionBy("bucket").orderBy("line_id")
    met = met.withColumn("part", F.floor((F.row_number().over(order) - 1) / chunk))
    met = met.withColumn("parts", F.max("part").over(in_bucket))
    wanted = met.select("line_id").distinct()
    texts = _once(long_lines).join(wanted, "line_id", "left_semi").distinct()
    full = met.join(texts, "line_id").withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), "parts")))
    low, high = F.least("part", "other"), F.greatest("part", "other")
    full = full.select("bucket", low.alias("i"), high.alias("j"), (F.col("part") == high).alias("second"), "own", "line")
    work = full.groupBy("bucket", "i", "j").agg(F.collect_list(F.struct("second", "own", "line")).alias("members"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from hashlib import md5

        for frame in frames:
            a, b = [], []
            for i, j, members in zip(frame["i"], frame["j"], frame["members"], strict=True):
                one = sorted((m["line"], m["own"]) for m in members if not m["second"] or i == j)
                two = one if i == j else sorted((m["line"], m["own"]) for m in members if m["second"])
                for x, x_own in one:
                    for y, y_own in two:
                        if (i != j or x < y) and (x_own or y_own) and within_edits(x, y, allowed(max(len(x), len(y)), max_edits, chars_per_edit)):
                            u, v = (md5(t.encode("utf-8", "surrogatepass")).hexdigest() for t in (x, y))
                            a.append(min(u, v))
                            b.append(max(u, v))
            yield pd.DataFrame({"a": a, "b": b}, dtype="object")

    return work.select("i", "j", "members").mapInPandas(run, "a string, b string").distinct()


def dedupe_lines(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    max_edits: int = MAX_EDITS,
    min_chars: int = MIN_CHARS,
    chars_per_edit: int = CHARS_PER_EDIT,
) -> DataFrame:
    """A row for every line of every row of ``docs``:
    (doc_id, key, line_no, line_id, class_id, links, kept).

    Lines are what newlines separate, whole. class_id is the least MD5 that links of up to
    ``max_edits`` edits (characters put in, left out or changed) reach from the line, of fewer if
    the longer line has not ``chars_per_edit`` characters for each; exact copies are of one class
    at any length. links is the number of other texts it is linked to; kept marks the first
    line of a class by (doc_id, key, line_no), rows without an id last. Empty lines and those of
    fewer than ``min_chars`` characters, with 1 none, are kept, with null class and no links.
    Null and empty texts have one empty line. Rows that repeat a document stand at
    the same place and are kept or dropped together. Other columns of ``docs`` play no part.
    """
    every = lines(docs, id_col, text_col)
    is_long = F.length("line") >= max(min_chars, 1)
    pairs = cut_lineage(links(every.where(is_long).select("line"), max_edits, chars_per_edit=chars_per_edit))
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    degree = both.groupBy("a").agg(F.count("*").alias("links"))
    linked = degree.join(components(pairs).withColumnRenamed("node", "a"), "a", "left")
    linked = cut_lineage(linked.select(F.col("a").alias("line_id"), F.coalesce("root", "a").alias("root"), "links"))
    # Short lines keep an identity of their own place, so that they do not meet in one key.
    place = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "key", "line_no")
    at = cut_lineage(every.select("doc_id", "key", "line_no", F.when(is_long, _identity()).alias("line_id")))
    placed = at.where("line_id is not null").join(linked, "line_id", "left")
    placed = placed.withColumn("class_id", F.coalesce("root", "line_id")).withColumn("place", place)
    # Only classes of several lines need a first one. It is a table of its own, so that in the
    # join a class that very many lines belong to can be split among tasks.
    first = placed.groupBy("class_id").agg(F.min("place").alias("first"), F.count("*").alias("n"))
    first = cut_lineage(first.where("n > 1").drop("n"))
    kept = F.col("first").isNull() | (F.col("place") == F.col("first"))
    judged = placed.join(first, "class_id", "left").select(
        "doc_id", "key", "line_no", "line_id", "class_id", F.coalesce("links", F.lit(0)).cast("long").alias("links"), kept.alias("kept")
    )
    short = at.where("line_id is null").select(
        "doc_id", "key", "line_no", "line_id", F.lit(None).cast("string").alias("class_id"), F.lit(0).cast("long").alias("links"), F.lit(True).alias("kept")
    )
    return judged.unionByName(short)


def drop_repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", count_col: str | None = "n_chars", **limits) -> DataFrame:
    """``docs`` with repeated lines cut out of the texts; all rows and columns stay.

    A text all of whose lines stand elsewhere becomes empty. ``count_col``, if ``docs`` has it, is
    set to the new number of characters where a text has changed.
    """
    cut = dedupe_lines(docs, id_col, text_col, **limits).where("not kept").groupBy("doc_id", "key").agg(F.collect_set("line_no").alias("_cut"))
    cut = cut.select(F.col("doc_id").alias("_id"), F.col("key").alias("_key"), "_cut")
    match = docs[id_col].eqNullSafe(F.col("_id")) & (text_key(docs[text_col]) == F.col("_key"))
    joined = docs.join(cut, match, "left")
    left = F.filter(F.split(docs[text_col], "\n", -1), lambda _, i: ~F.array_contains("_cut", i))
    joined = joined.withColumn("_text", F.when(F.col("_cut").isNull(), docs[text_col]).otherwise(F.array_join(left, "\n")))
    new = {text_col: F.col("_text")}
    if count_col in docs.columns:
        counted = F.length("_text").cast(docs.schema[count_col].dataType)
        new[count_col] = F.when(F.col("_cut").isNull(), docs[count_col]).otherwise(counted)
    return joined.select(*[new[c].alias(c) if c in new else docs[c] for c in docs.columns])
