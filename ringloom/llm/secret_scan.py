"""Secret scans with multipart credential linking.

Strong patterns count by themselves. Weak ones (identifiers, strings that look random, and
endpoints) are parts: each is reported only if a complementary part stands within its scope,
which an interval join over positions decides.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ringloom.llm.common import cut_lineage, digest_of, text_key

SCOPE_CHARS = 200  # how far apart parts of one credential may stand
MIN_ENTROPY = 3.5  # bits a character of a string that looks random

# The strong patterns and how long their matches must be.
ASSIGN = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{32,}"  # the runs of [0-9a-f]+ that are long enough
ASSIGN_CHARS, ACCESS_CHARS = 8, 16
KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")

KINDS = ("assign", "access", "hex", "part_id", "part_secret", "part_endpoint")
ROLES = {"assign": "secret", "access": "id", "hex": "secret", "part_id": "id", "part_secret": "secret", "part_endpoint": "endpoint"}

_ASSIGN = re.compile(ASSIGN, re.IGNORECASE | re.ASCII)
_ACCESS = re.compile(ACCESS)
_HEX = re.compile(HEX)
_ID = re.compile(r"""(?:ASIA|AROA|AIDA)[A-Z0-9]{12,}|\b(?:client_?id|user(?:name)?|login|account)["']?\x20*[:=]\x20*["']?[A-Za-z0-9_.@-]{3,}""", re.IGNORECASE | re.ASCII)
_RANDOM = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}={0,2}", re.ASCII)
_DIGIT = re.compile(r"[0-9]", re.ASCII)
_IPV4 = re.compile(r"\b(?:\d{1,3}\.){3}\d{1,3}(?::\d{2,5})?\b", re.ASCII)
_ENDPOINT = re.compile(r"://[^\s\"'<>]{4,}|" + _IPV4.pattern, re.ASCII)
_SCHEME = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+-")
_LONG_WORD = re.compile(r"[A-Za-z0-9+/_-]{20}", re.ASCII)


def strong_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end), leftmost and not overlapping within a kind, by start and kind."""
    found = []
    lowered = text.lower()
    if any(k in lowered for k in KEYWORDS):
        found += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_CHARS]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_CHARS]
    found += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return sorted(found)


def _entropy(value: str) -> float:
    return -sum(n / len(value) * math.log2(n / len(value)) for n in Counter(value).values())


def _endpoints(text: str) -> Iterator[tuple[int, int]]:
    """Bounds of scheme://host and what follows, of any scheme, and of IPv4 addresses. A scheme is
    looked for backwards from its colon, so that a long word without one is not read again."""
    at = 0
    for m in _ENDPOINT.finditer(text):
        start = m.start()
        if text[start] != ":":
            yield start, m.end()
        else:
            while start > at and text[start - 1] in _SCHEME:
                start -= 1
            while not text[start].isalpha() and start < m.start():
                start += 1
            if start < m.start():
                yield start, m.end()
            else:
                yield from (ip.span() for ip in _IPV4.finditer(text, m.start(), m.end()))
        at = m.end()


def weak_spans(text: str, strong: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """(start, kind, end) of parts that mean nothing alone and do not overlap ``strong`` ones."""
    found = []
    if "=" in text or ":" in text or "AIDA" in text or "AROA" in text or "ASIA" in text:
        found += [(m.start(), 3, m.end()) for m in _ID.finditer(text)]
    if _LONG_WORD.search(text):
        found += [(m.start(), 4, m.end()) for m in _RANDOM.finditer(text) if _DIGIT.search(m[0]) and _entropy(m[0]) >= MIN_ENTROPY]
    found += [(start, 5, end) for start, end in _endpoints(text)]
    taken = [(a, b) for a, _, b in strong]
    kept, at = [], 0
    for start, kind, end in sorted(found):
        while at < len(taken) and taken[at][1] <= start:
            at += 1
        if not any(a < end and start < b for a, b in taken[at : at + 4]):
            kept.append((start, kind, end))
    return kept


_SPANS = "array<struct<start:bigint,kind:int,end:bigint>>"


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, key, strong, weak): the spans of every row of ``docs``."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            strong = [strong_spans(t) for t in frame["text"]]
            weak = [weak_spans(t, s) for t, s in zip(frame["text"], strong, strict=True)]
            yield pd.DataFrame({"doc_id": frame["doc_id"], "key": frame["key"], "strong": strong, "weak": weak})

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(
        F.col(id_col).cast("string").alias("doc_id"),
        text_key(F.col(text_col)).alias("key"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"),
    )
    found = rows.mapInPandas(run, f"doc_id string, key long, strong {_SPANS}, weak {_SPANS}")
    return found.withColumn("doc_id", F.col("doc_id").cast(kind))


def link_parts(found: DataFrame, scope: int = SCOPE_CHARS) -> DataFrame:
    """(doc_id, key, linked): the weak spans that a complementary part stands near.

    Complementary are a secret and an identifier, and a secret and an endpoint; parts are near
    if at most ``scope`` characters lie between them. Positions are cut into bins of ``scope``
    characters: a part stands in the bins it covers and looks in those its scope covers, so a
    key of the join holds no more than what fits into a bin of one document.
    """
    role = F.element_at(F.create_map(*[F.lit(x) for i, k in enumerate(KINDS) for x in (i, ROLES[k])]), F.col("kind"))
    every = found.where(F.size("weak") > 0).select("doc_id", "key", F.explode(F.concat("strong", "weak")).alias("s")).distinct()
    parts = every.select("doc_id", "key", "s.start", "s.kind", "s.end").withColumn("role", role)
    bin_of = lambda c: F.floor(c / F.lit(scope))
    there = parts.select(
        F.col("doc_id").alias("_id"), F.col("key").alias("_key"), F.col("start").alias("_start"), F.col("end").alias("_end"),
        F.col("role").alias("_role"), F.explode(F.sequence(bin_of(F.col("start")), bin_of(F.col("end")))).alias("_bin"),
    )
    lo, hi = bin_of(F.greatest(F.col("start") - scope, F.lit(0))), bin_of(F.col("end") + scope)
    here = parts.where(F.col("kind") >= 3).withColumn("bin", F.explode(F.sequence(lo, hi)))
    near = (
        F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("key") == F.col("_key")) & (F.col("bin") == F.col("_bin"))
        & (F.col("_start") <= F.col("end") + scope) & (F.col("start") <= F.col("_end") + scope)
        & (F.col("role") != F.col("_role")) & ((F.col("role") == "secret") | (F.col("_role") == "secret"))
    )
    hit = here.join(there, near, "left_semi").select("doc_id", "key", "start", "kind", "end").distinct()
    return hit.groupBy("doc_id", "key").agg(F.collect_list(F.struct("start", "kind", "end")).alias("linked"))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", scope: int = SCOPE_CHARS) -> DataFrame:
    """(doc_id, key, strong, spans) for every row of ``docs``: arrays of (start, kind, end), in
    code points, by start and kind (a place in ``KINDS``); spans has strong and linked ones.

    A null text is empty: no spans. Repeated rows get a row each; null ids and other columns of
    ``docs`` are no obstacle. No rows: no rows.
    """
    found = cut_lineage(candidates(docs, id_col, text_col))
    linked = link_parts(found, scope).select(F.col("doc_id").alias("_id"), F.col("key").alias("_key"), "linked")
    joined = found.join(linked, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("key") == F.col("_key")), "left")
    more = F.coalesce("linked", F.array().cast(_SPANS))
    return joined.select("doc_id", "key", "strong", F.array_sort(F.concat("strong", more)).alias("spans"))


def digest_columns(scanned: DataFrame) -> DataFrame:
    """Counts and strings of the spans of each row."""
    name = lambda s: F.element_at(F.array([F.lit(k) for k in KINDS]), s["kind"] + 1)
    said = lambda c: F.transform(c, lambda s: F.concat_ws(":", name(s), s["start"], s["end"]))
    count = lambda i: F.size(F.filter("strong", lambda s: s["kind"] == i)).cast("long")
    return scanned.select(
        "doc_id",
        count(0).alias("n_assign"),
        count(1).alias("n_access"),
        count(2).alias("n_hex"),
        digest_of(said("strong")).alias("base_sha256"),
        F.array_join(said("spans"), ",").alias("spans"),
    )
