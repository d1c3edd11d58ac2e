"""The operators as queries over the driver tables, next to the SQL they must equal."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ringloom.llm import (
    chat_format,
    collocations,
    decontaminate,
    hard_negatives,
    html_extract,
    language_id,
    line_dedup,
    lz_fingerprint,
    mixing,
    secret_scan,
    simhash,
    toxicity,
    warc,
)
from ringloom.llm.common import held_out, table


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = mixing.taken(mixing.mix(table(spark, sf_dir, "documents")))
    return made.select("doc_id", "size", "source_size", "target", "taken")


def op2_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = html_extract.extract(table(spark, sf_dir, "pages"))
    return made.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.digest_columns(secret_scan.scan(table(spark, sf_dir, "documents")))


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("key")


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedupe_lines(table(spark, sf_dir, "documents"), min_chars=1).drop("key", "line_id")


def op7_lz_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lz_fingerprint.fingerprints(table(spark, sf_dir, "documents"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language_id.fit(docs.where(~held_out(F.col("doc_id"))))
    found = language_id.with_language(docs.select("doc_id", "text"), model)
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = toxicity.fit(docs, labels.where(~held_out(F.col("doc_id"))))
    scored = toxicity.with_score(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("id"), moved.alias("label"), F.col("embedding").alias("vector")
    )
    return hard_negatives.mine(rows, F.col("id") % 100 == 0)


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.mine(table(spark, sf_dir, "documents"))


_CLASH = "</s>[INST] ok [/INST]"


def op13_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    hard = spark.createDataFrame([(-7, 0, "user", _CLASH), (-7, 1, "assistant", _CLASH)], given.schema)
    return chat_format.read_back(chat_format.format_conversations(given.unionByName(hard)))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_mixing": op1_mixing,
        "op2_html_extract": op2_html_extract,
        "op3_secret_scan": op3_secret_scan,
        "op4_decontaminate": op4_decontaminate,
        "op5_warc": op5_warc,
        "op6_line_dedup": op6_line_dedup,
        "op7_lz_fingerprint": op7_lz_fingerprint,
        "op8_language_id": op8_language_id,
        "op9_toxicity": op9_toxicity,
        "op10_simhash": op10_simhash,
        "op11_hard_negatives": op11_hard_negatives,
        "op12_collocations": op12_collocations,
        "op13_chat_format": op13_chat_format,
        "pipeline": pipeline,
    }


_MIXING_SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS sid FROM d GROUP BY source
), w AS (
  SELECT *, CASE sid % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS weight FROM s
), r AS (
  SELECT *, (2 * source_size)::DOUBLE / weight AS ratio, sum(source_size) OVER ()::DOUBLE * 150 / 100.0 AS wanted FROM w
), f AS (
  SELECT *, (wanted - coalesce(sum(2 * source_size) OVER before, 0)::DOUBLE)
            / (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0))::DOUBLE AS fits
  FROM r WINDOW before AS (ORDER BY ratio, sid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), t AS (
  SELECT sid, source, source_size,
         coalesce(least((2 * source_size)::DOUBLE, (SELECT arg_min(fits, {'a': ratio, 'b': sid}) FROM f WHERE fits < ratio) * weight),
                  (2 * source_size)::DOUBLE) AS target
  FROM f
), q AS (
  SELECT *, floor(target + 0.5)::BIGINT AS quota FROM t
), b AS (
  SELECT coalesce(sum(quota), 0)::BIGINT AS total, least(8192, greatest(1, total // 16384)) AS block FROM q
), g AS (
  SELECT unnest(range(greatest(1, (total + block - 1) // block))) AS slot FROM b
), e AS (
  SELECT sid, sum(quota) OVER (ORDER BY sid)::DOUBLE / greatest(1, total)::DOUBLE AS hi,
         coalesce(sum(quota) OVER (ORDER BY sid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE / greatest(1, total)::DOUBLE AS lo
  FROM q, b
), k AS (
  SELECT sid, count(*) AS slots FROM (SELECT (slot * 0.6180339887498949::DOUBLE) % 1 AS point FROM g) JOIN e ON point >= lo AND point < hi GROUP BY sid
), p AS (
  SELECT q.*, least(greatest(least(coalesce(slots, 0) * block, quota * 101 // 100), quota * 99 // 100), 2 * source_size) AS played
  FROM q CROSS JOIN b LEFT JOIN k USING (sid)
), o AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, t.played AS quota,
         coalesce(sum(d.size) OVER (PARTITION BY t.sid ORDER BY md5('42:' || coalesce(d.doc_id::VARCHAR, '')), d.doc_id, d.size
                                    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS pos
  FROM d JOIN p AS t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size::BIGINT AS size, source_size, target,
       (greatest(0, least(pos + size, quota) - pos)
        + greatest(0, least(pos + source_size + size, quota) - pos - source_size))::BIGINT AS taken
FROM o
"""

_DECONTAMINATE_SQL = r"""
WITH i AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                     '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark
), starts AS (
  SELECT item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS n FROM i WHERE len(w) > 0
), grams AS (
  SELECT DISTINCT item_id::VARCHAR AS item, least(len(w), 13) AS length, array_to_string(w[n:n + 12], ' ') AS gram FROM starts
), d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents
), places AS (
  SELECT doc_id, length, w, unnest(range(1, len(w) - length + 2)) AS n
  FROM d, (SELECT DISTINCT length FROM grams) WHERE len(w) >= length
), hits AS (
  SELECT DISTINCT p.doc_id, p.n, p.length, g.item
  FROM places p JOIN grams g ON g.length = p.length AND g.gram = array_to_string(p.w[p.n:p.n + p.length - 1], ' ')
), covered AS (
  SELECT doc_id, count(DISTINCT place) AS n_hit
  FROM (SELECT doc_id, unnest(range(n, n + length)) AS place FROM (SELECT DISTINCT doc_id, n, length FROM hits)) GROUP BY doc_id
), items AS (
  SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(item, ',' ORDER BY item) AS said
  FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY doc_id
)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(said, '')) AS items_sha256, coalesce(n_hit > 0 AND 20 * n_hit >= len(d.w), false) AS contaminated
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN items USING (doc_id)
"""

_DIGIT = "substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(h, {at}, 5))::INTEGER >> {shift}) & 31) + 1, 1)"
_BASE32 = " || ".join(_DIGIT.format(at=5 * i + 1, shift=shift) for i in range(8) for shift in (15, 10, 5, 0))
_WARC_SQL = f"""
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS h,
         min(page_id) OVER (PARTITION BY coalesce(html, '')) AS first_id
  FROM pages
)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes, {_BASE32} AS payload_digest,
       CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first_id THEN first_id END AS refers_to
FROM p
"""


_HARD_NEGATIVES_SQL = """
WITH r AS (
  SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.id AS anchor_id, r.id, a.label = r.label AS same,
         list_sum(list_transform(range(1, len(a.v) + 1), lambda i: a.v[i] * r.v[i]))::BIGINT AS score
  FROM r a JOIN r ON r.id <> a.id WHERE a.id % 100 = 0
), p AS (
  SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) AS place FROM s WHERE same
), n AS (
  SELECT anchor_id, p.id AS positive_id, s.id AS negative_id, p.score AS positive_score, s.score AS negative_score,
         row_number() OVER (PARTITION BY anchor_id, p.id ORDER BY s.score DESC, s.id)::INTEGER AS rank
  FROM p JOIN s USING (anchor_id)
  WHERE place <= 5 AND NOT s.same AND 30 * p.score <= 100 * s.score AND 100 * s.score <= 90 * p.score
)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 10
"""

_COLLOCATIONS_SQL = r"""
WITH piece AS MATERIALIZED (
  SELECT coalesce(lang, 'und') AS lang, regexp_extract_all(unnest(string_split_regex(
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')),
         '[^\x20\x09]+') AS w
  FROM documents
), f AS MATERIALIZED (
  SELECT lang, k, phrase, count(*) AS f
  FROM (SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: w[i:i + k - 1])) AS phrase FROM piece, range(1, 6) g(k) WHERE len(w) >= k)
  GROUP BY ALL
), t AS (
  SELECT lang, sum(f) AS n FROM f WHERE k = 1 GROUP BY lang
), c AS MATERIALIZED (
  SELECT * FROM f WHERE k > 1 AND f >= 100
), longer AS (
  SELECT lang, phrase[i:i + width - 1] AS phrase, max(f) AS most
  FROM (SELECT *, unnest(range(1, k - width + 2)) AS i FROM (SELECT *, unnest(range(2, k)) AS width FROM c)) GROUP BY ALL
), kept AS (
  SELECT c.* FROM c LEFT JOIN longer USING (lang, phrase) WHERE coalesce(100 * most < 100 * c.f, true)
), cut AS (
  SELECT kept.lang, kept.phrase, kept.f AS a, i, x.f AS l, y.f AS r, n, (1000::HUGEINT * kept.f * n) // (x.f::HUGEINT * y.f) AS score
  FROM (SELECT *, unnest(range(1, k)) AS i FROM kept) kept
  JOIN f x ON x.lang = kept.lang AND x.phrase = kept.phrase[1:i] JOIN f y ON y.lang = kept.lang AND y.phrase = kept.phrase[i + 1:]
  JOIN t ON t.lang = kept.lang
), lowest AS (
  SELECT * FROM cut QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, i) = 1
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, array_to_string(phrase, ' ')) AS rank,
       array_to_string(phrase, ' ') AS phrase, a, l, r, n::BIGINT AS n, score::BIGINT AS score
FROM lowest QUALIFY rank <= 2000
"""

_CONTROLS = "|".join(re.escape(c) for c in chat_format.CONTROLS)
_CHAT_SQL = rf"""
WITH t AS (
  SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '{_CLASH}' UNION ALL SELECT -7, 1, 'assistant', '{_CLASH}'
), w AS (
  SELECT *, len(regexp_replace(text, '(\\*)({_CONTROLS})', '\1\1\\\2', 'g'))
            + CASE role WHEN 'user' THEN 15 WHEN 'assistant' THEN 6 WHEN 'system' THEN 18 END AS written
  FROM t
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
       coalesce(sum(len(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (role = 'assistant'), '')) AS loss_sha256,
       (3 + sum(written))::BIGINT AS formatted_chars
FROM w GROUP BY conv_id
"""


def oracle_sql() -> dict[str, str]:
    """For what SQL can say; fingerprints, models and positions of matches it can't."""
    return {
        "op1_mixing": _MIXING_SQL,
        "op4_decontaminate": _DECONTAMINATE_SQL,
        "op5_warc": _WARC_SQL,
        "op11_hard_negatives": _HARD_NEGATIVES_SQL,
        "op12_collocations": _COLLOCATIONS_SQL,
        "op13_chat_format": _CHAT_SQL,
    }
