"""Mixing sources to target weights by a low-discrepancy schedule.

Slot i of the schedule is the golden-ratio point frac(i * phi). Mapped through the cumulative
targets it falls on a source, and its rank among that source's slots says which block of the
source it plays. The documents of a source are shuffled into a line of words, repeated, and
cut into blocks of one length for all sources; joining slots to blocks gives the mix. Low
discrepancy keeps every stretch of the schedule near the target weights. A source plays as many
blocks as it has slots, so the schedule decides what is taken; where that misses the target by
more than a hundredth, as it may for a source of few blocks, the last block is cut or slots are
added after the end of the schedule.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ringloom.llm.common import cut_lineage, running_total

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (3, 1, 2)
SHARE_PERCENT = 150
MAX_REPEATS = 2
BLOCK_WORDS = 8192  # at most; fewer where that would give fewer than LEAST_SLOTS
LEAST_SLOTS = 1 << 14
TOLERANCE_PERCENT = 1  # how far a source may end from its target
GOLDEN = 0.6180339887498949
BINS = 1024
MAX_BROADCAST_SOURCES = 100_000  # beyond, Spark chooses how to join sources


class Mix(NamedTuple):
    documents: DataFrame  # sid, pos, doc_id, source, size, source_size, target
    sources: DataFrame  # sid, source, source_size, target, quota, slots, played, block
    schedule: DataFrame  # slot, sid, rank
    picks: DataFrame  # slot, sid, pos, doc_id, first_word, words


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sized: DataFrame, weights=WEIGHTS, share_percent=SHARE_PERCENT, repeats=MAX_REPEATS) -> DataFrame:
    """(sid, source, source_size, rows, target): one row per source.

    Capping a source and sharing its excess again by weight, until nothing is above its cap,
    ends at one level: a source gets the smaller of its cap and level * weight. Sources in the
    order of cap / weight are capped up to the first whose share fits. The two windows run
    over sources, not documents.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    src = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("rows"))
    src = src.withColumn("sid", F.row_number().over(by_name) - 1)
    src = src.withColumn("weight", F.element_at(F.array([F.lit(w) for w in weights]), F.col("sid") % len(weights) + 1))
    cap, weight = F.col("source_size") * repeats, F.col("weight")
    ordered = Window.orderBy(F.col("ratio"), "sid")
    before = ordered.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    src = src.withColumn("ratio", cap.cast("double") / weight)
    wanted = F.sum("source_size").over(everything) * share_percent / F.lit(100.0)
    capped = F.coalesce(F.sum(cap).over(before), F.lit(0))
    open_weight = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    src = src.withColumn("fits", (wanted - capped) / open_weight)
    first_to_fit = F.when(F.col("fits") < F.col("ratio"), F.struct("ratio", "sid"))
    src = src.withColumn("level", F.min_by("fits", first_to_fit).over(everything))
    level = F.coalesce(F.least(cap.cast("double"), F.col("level") * weight), cap.cast("double"))
    return src.select("sid", "source", "source_size", "rows", level.alias("target"))


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    block_words: int | None = None,
    seed: int = 42,
    **shares,
) -> Mix:
    """The mix of all rows of ``docs``, in blocks of ``block_words`` (None: by the constants above).

    A null source is a source (the last one); null, empty and blank texts have size 0 and are
    never picked; a null id shuffles like an empty one. Rows that repeat an id are rows of
    their own. Sizes are kept in the shared folder so that texts are read once. No rows: an
    empty mix. Other columns of ``docs`` play no part.
    """
    spark = docs.sparkSession
    sized = cut_lineage(
        docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), n_words(F.col(text_col)).alias("size"))
    )
    sources = cut_lineage(
        source_targets(sized, **shares)
        .withColumn("quota", F.floor(F.col("target") + 0.5))
        .withColumn("buckets", F.ceil(F.sqrt("rows")))
    )
    quota, n_sources = sources.agg(F.coalesce(F.sum("quota"), F.lit(0)), F.count("*")).first()
    small = F.broadcast if n_sources <= MAX_BROADCAST_SOURCES else (lambda df: df)

    # Documents, laid out in a line per source.
    named = small(sources.select("sid", F.col("source").alias("_source"), "source_size", "target", "buckets"))
    dealt = sized.join(named, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    dealt = dealt.withColumn("draw", F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary")))
    first = F.conv(F.substring("draw", 1, 8), 16, 10).cast("double") / float(1 << 32)
    dealt = dealt.withColumn("bucket", F.floor(first * F.col("buckets")))
    line = cut_lineage(
        running_total(dealt, ["sid"], "bucket", ["draw", "doc_id", "size"], F.col("size"), "pos").select(
            "sid", "pos", "doc_id", "source", "size", "source_size", "target"
        )
    )

    # The schedule.
    block = block_words or min(BLOCK_WORDS, max(1, int(quota) // LEAST_SLOTS))
    n_slots = max(1, -(-int(quota) // block))
    slots = spark.range(n_slots).select(F.col("id").alias("slot"), ((F.col("id") * GOLDEN) % 1).alias("point"))
    along = Window.orderBy("sid")
    top = (F.sum("quota").over(along) / F.lit(float(max(1, quota)))).alias("hi")
    spans = sources.where("quota > 0").select("sid", "quota", top).withColumn("lo", F.coalesce(F.lag("hi").over(along), F.lit(0.0)))
    bins = F.sequence(F.floor(F.col("lo") * BINS), F.least(F.floor(F.col("hi") * BINS), F.lit(BINS - 1).cast("long")))
    spans = small(spans.select("sid", "lo", "hi", F.explode(bins).alias("bin")))
    slots = slots.withColumn("bin", F.floor(F.col("point") * BINS)).join(spans, "bin").where("point >= lo and point < hi")
    slots = slots.withColumn("stretch", F.floor(F.col("slot") / F.lit(max(1, int(n_slots**0.5)))))
    ranked = running_total(slots, ["sid"], "stretch", ["slot"], F.lit(1), "rank").select("slot", "sid", "rank")
    counted = ranked.groupBy("sid").agg(F.count("*").alias("slots"))
    repeats = shares.get("repeats", MAX_REPEATS)
    sources = sources.join(counted, "sid", "left").withColumn("slots", F.coalesce("slots", F.lit(0)))
    least, most = (F.expr(f"quota * {100 + sign * TOLERANCE_PERCENT} div 100") for sign in (-1, 1))
    played = F.least(F.greatest(F.least(F.col("slots") * block, most), least), F.col("source_size") * repeats)
    sources = sources.withColumn("played", played).withColumn("block", F.lit(block).cast("long"))
    sources = cut_lineage(sources.select("sid", "source", "source_size", "target", "quota", "slots", "played", "block"))
    wanted = F.ceil(F.col("played") / F.col("block"))
    added = sources.where(wanted > F.col("slots")).select("sid", F.explode(F.sequence(F.col("slots"), wanted - 1)).alias("rank"))
    schedule = ranked.unionByName(added.select((n_slots + F.col("rank") * n_sources + F.col("sid")).alias("slot"), "sid", "rank"))

    # Pieces of documents in blocks: at most one more than a document's words fill.
    lengths = small(sources.where("played > 0").select("sid", "played", "block"))
    pieces = line.where("size > 0").join(lengths, "sid")
    pieces = pieces.withColumn("turn", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))
    pieces = pieces.withColumn("from", F.col("pos") + F.col("turn") * F.col("source_size"))
    pieces = pieces.withColumn("to", F.least(F.col("from") + F.col("size"), F.col("played"))).where("from < to")
    pieces = pieces.withColumn("rank", F.explode(F.sequence(F.floor(F.col("from") / F.col("block")), F.floor((F.col("to") - 1) / F.col("block")))))
    lo = F.greatest("from", F.col("rank") * F.col("block"))
    hi = F.least("to", (F.col("rank") + 1) * F.col("block"))
    pieces = pieces.select("sid", "rank", "pos", "doc_id", (lo - F.col("from")).alias("first_word"), (hi - lo).alias("words"))
    picks = schedule.join(pieces, ["sid", "rank"]).select("slot", "sid", "pos", "doc_id", "first_word", "words")
    return Mix(line, sources, schedule, picks)


def taken(made: Mix) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken): what the mix takes of every row."""
    sums = made.picks.groupBy("sid", "pos").agg(F.sum("words").alias("taken"))
    # A document without words shares its place in the line with the next one.
    some = made.documents.where("size > 0").join(sums, ["sid", "pos"], "left")
    none = made.documents.where("size = 0").withColumn("taken", F.lit(0).cast("long"))
    columns = ["doc_id", "source", "size", "source_size", "target", "taken"]
    return some.withColumn("taken", F.coalesce("taken", F.lit(0))).select(columns).unionByName(none.select(columns))
