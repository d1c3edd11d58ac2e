"""WARC archives: written from pages, read back, and assembled into captures.

A capture is a transaction of several records: the response (or a revisit of an equal payload),
the request, and metadata. The records name each other by WARC-Concurrent-To, each any number of
others; what such names connect is one capture, and assembly emits one nested row for it.
"""

from __future__ import annotations

import gzip
import io
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ringloom.llm import graph
from ringloom.llm.common import cut_lineage
from ringloom.operators import sizing
from ringloom.operators.lineage import shared_folder

# A task reads an archive record by record, but has its compressed bytes whole: pages of up to so many
# bytes go together, so many records to a file, and a file has about 48 MB before compression.
SIZES = ((16 << 10, 9_000), (512 << 10, 288), (2 << 30, 6))
CRLF = "\r\n"
PRINCIPAL = ("response", "revisit", "resource")
_DIGITS, _BASE32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
_REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def payload_digest(payload: Column) -> Column:
    """SHA-1 in upper-case base 32."""
    return base32(F.sha1(payload))


def base32(hex_digest: Column) -> Column:
    """Of 40 hex digits: ten at a time are eight digits of base 32."""
    parts = [F.lpad(F.conv(F.substring(hex_digest, 10 * i + 1, 10), 16, 32), 8, "0") for i in range(4)]
    return F.translate(F.concat(*parts), _DIGITS, _BASE32)


def _id(kind: str) -> Column:
    """A record's name, from the row's place in the job: rows that are equal have names of their own."""
    digest = F.md5(F.concat_ws(":", F.lit(kind), F.col("row"), F.coalesce(F.col("page_id").cast("string"), F.lit(""))).cast("binary"))
    cut = [F.substring(digest, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("urn:uuid:"), F.concat_ws("-", *cut))


def _record(fields: list[tuple[str, Column]], block: Column) -> Column:
    """Header and block, without the blank lines that end a record; null fields are left out."""
    lines = [F.when(v.isNotNull(), F.concat(F.lit(f"{k}: "), v)) for k, v in fields]
    header = F.concat_ws(CRLF, F.lit("WARC/1.1"), *lines, F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string")))
    return F.concat(header.cast("binary"), F.lit(CRLF * 2).cast("binary"), block)


def first_of_equal(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """``pages`` (page_id, sha1, n_bytes, ...) with ``first_id``: the smallest id of an equal payload.

    The smallest ids are summed up on the map side, so a payload that very many pages share is
    a row there. Those of payloads that repeat are broadcast if, counted, they fit; payloads do not
    move then. Null ids are not counted; payloads under ``min_bytes`` have no first.
    """
    first = pages.where(F.col("n_bytes") >= min_bytes).groupBy("sha1", "n_bytes").agg(F.min("page_id").alias("first_id"), F.count("*").alias("n"))
    first = cut_lineage(first.where("n > 1").drop("n"))
    return pages.join(sizing.broadcast_if_small(first), ["sha1", "n_bytes"], "left")


def write(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_bytes: int = 0, date: str = "2024-01-01T00:00:00Z") -> None:
    """Archives of a request, a response or revisit, and a metadata record for every row.

    The payload is a string or binary column, whole; null is empty. A null url leaves the target
    out; control characters and spaces in urls are percent-encoded. Files are gzip-compressed; pages
    of like size go to a folder of their own, with a number of records a file that bounds its bytes.
    """
    payload = F.coalesce(F.col(payload_col).cast("binary"), F.lit("").cast("binary"))
    url = F.col(url_col).cast("string")
    for raw, coded in ((" ", "%20"), ("\r", "%0D"), ("\n", "%0A"), ("\t", "%09")):
        url = F.replace(url, F.lit(raw), F.lit(coded))
    rows = pages.select(F.col(id_col).alias("page_id"), url.alias("url"), payload.alias("payload"))
    rows = rows.withColumn("sha1", F.sha1("payload")).withColumn("n_bytes", F.octet_length("payload").cast("long"))
    rows = first_of_equal(rows, min_bytes).withColumn("row", F.monotonically_increasing_id()).withColumn("digest", base32(F.col("sha1")))
    revisit = F.coalesce(~F.col("page_id").eqNullSafe(F.col("first_id")) & F.col("first_id").isNotNull(), F.lit(False))
    name = {k: F.concat(F.lit("<"), _id(k), F.lit(">")) for k in ("response", "request", "metadata")}
    target, when = ("WARC-Target-URI", F.col("url")), ("WARC-Date", F.lit(date))
    http = F.concat(
        F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.col("n_bytes").cast("string"), F.lit(CRLF * 2)
    ).cast("binary")
    host = F.regexp_extract("url", r"^[a-z]+://([^/?#]*)", 1)
    path = F.regexp_extract("url", r"^[a-z]+://[^/?#]*([^#]*)", 1)
    asked = F.concat(F.lit("GET "), F.coalesce(path, F.lit("/")), F.lit(f" HTTP/1.1{CRLF}Host: "), F.coalesce(host, F.lit("")), F.lit(CRLF * 2))
    about = F.concat(F.lit("page-id: "), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.lit(CRLF))
    about = F.concat(about, F.when(revisit, F.concat(F.lit("refers-to-page-id: "), F.col("first_id").cast("string"), F.lit(CRLF))).otherwise(""))
    answer = _record(
        [
            ("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
            ("WARC-Record-ID", name["response"]), when, target,
            ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
            ("WARC-Profile", F.when(revisit, _REVISIT_PROFILE)),
            ("Content-Type", F.lit("application/http; msgtype=response")),
        ],
        F.when(revisit, http).otherwise(F.concat(http, F.col("payload"))),
    )
    to = ("WARC-Concurrent-To", name["response"])
    request = _record([("WARC-Type", F.lit("request")), ("WARC-Record-ID", name["request"]), when, target, to, ("Content-Type", F.lit("application/http; msgtype=request"))], asked.cast("binary"))
    # The metadata names the request: a chain of two, as crawlers write it too.
    metadata = _record([("WARC-Type", F.lit("metadata")), ("WARC-Record-ID", name["metadata"]), when, target, ("WARC-Concurrent-To", name["request"]), ("Content-Type", F.lit("application/warc-fields"))], about.cast("binary"))
    records = rows.select("n_bytes", F.explode(F.array(answer, request, metadata)).alias("record"))
    # The text sink writes the bytes as they are, with the blank lines that end a record.
    lines = records.select("n_bytes", F.col("record").cast("string").alias("value"))
    largest = pages.agg(F.max(F.octet_length(F.col(payload_col).cast("binary")))).first()[0] or 0
    low = -1
    for n, (high, together) in enumerate(SIZES):
        part = lines.where((F.col("n_bytes") > low) & (F.col("n_bytes") <= high)).select("value")
        if low < largest:
            part.write.option("lineSep", CRLF * 2).option("compression", "gzip").option("maxRecordsPerFile", together).text(f"{folder}/{n}")
        low = high


class _Unpacked(io.RawIOBase):
    """Decompressed bytes, up to where the compressed ones are cut or broken."""

    def __init__(self, data: bytes):
        self.members = gzip.GzipFile(fileobj=io.BytesIO(data))

    def readable(self) -> bool:
        return True

    def readinto(self, out) -> int:
        try:
            got = self.members.read1(len(out))
        except (EOFError, gzip.BadGzipFile, zlib.error):
            return 0
        out[: len(got)] = got
        return len(got)


def parse(data: bytes) -> Iterator[tuple[dict[str, list[str]], bytes]]:
    """(fields in lower case, each with all its values; block) of every record of an archive, which
    may be compressed. Records are decompressed one by one. Reading ends at a record that does not
    end, and where the compressed data are cut or broken."""
    stream = io.BufferedReader(_Unpacked(data)) if data[:2] == b"\x1f\x8b" else io.BytesIO(data)
    while line := stream.readline():
        if line in (b"\r\n", b"\n"):
            continue
        if not line.startswith(b"WARC/"):
            return
        fields: dict[str, list[str]] = {}
        while (line := stream.readline()) != b"\r\n":
            if not line.endswith(b"\n"):
                return
            name, _, value = line.decode("utf-8", "replace").partition(":")
            fields.setdefault(name.strip().lower(), []).append(value.strip())
        size = int(fields.get("content-length", ["0"])[0])
        block = stream.read(size)
        if len(block) < size:
            return
        yield fields, block


RECORD = "record_id string, type string, concurrent_to array<string>, url string, date string, digest string, http string, payload binary"


def read(spark: SparkSession, folder: str) -> DataFrame:
    """A row for every record of the archives in ``folder``; payload is the block after its HTTP
    header, null for what has none."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [x.split()[0] for x in RECORD.split(", ")]
        for frame in frames:
            for content in frame["content"]:
                rows, size = [], 0
                for fields, block in parse(content):
                    one = lambda k, fields=fields: fields.get(k, [None])[0]
                    head, http = None, (one("content-type") or "").startswith("application/http")
                    if http:
                        head, _, block = block.partition(b"\r\n\r\n")
                    rows.append((
                        (one("warc-record-id") or "").strip("<>"), one("warc-type"),
                        [v.strip("<>") for v in fields.get("warc-concurrent-to", [])],
                        one("warc-target-uri"), one("warc-date"), (one("warc-payload-digest") or "").removeprefix("sha1:") or None,
                        head.decode("utf-8", "replace") if head is not None else None, block,
                    ))
                    size += len(block)
                    if size > 16 << 20:
                        yield pd.DataFrame(rows, columns=names)
                        rows, size = [], 0
                if rows:
                    yield pd.DataFrame(rows, columns=names)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").option("recursiveFileLookup", "true").load(folder).select("content")
    return files.mapInPandas(run, RECORD)


def assemble(records: DataFrame) -> DataFrame:
    """One row per capture: capture_id, principal (a struct), requests and metadata (arrays of them).

    ``records`` has record_id, type and concurrent_to (an array); its other columns go into the
    structs. Records that names connect, over any number of steps and in either direction, are one
    capture, also by way of a record that is not there. Its principal is the response, revisit or
    resource of the least id, which is capture_id too; without one it is the least id. What is no
    request and not the principal is in ``metadata``. Only names take part in finding captures; a
    record then moves once.
    """
    named = records.select(F.col("record_id").alias("a"), F.explode("concurrent_to").alias("b"))
    root = graph.components(named).select(F.col("node").alias("_node"), F.col("root").alias("_root"))
    joined = records.join(root, F.col("record_id") == F.col("_node"), "left")
    grouped = joined.groupBy(F.coalesce("_root", "record_id").alias("_root")).agg(
        F.min(F.when(F.col("type").isin(*PRINCIPAL), F.col("record_id"))).alias("_main"),
        F.min("record_id").alias("_least"),
        F.collect_list(F.struct(*records.columns)).alias("_all"),
    )
    main = lambda r: F.coalesce(r["record_id"] == F.col("_main"), F.lit(False))
    asks = lambda r: F.coalesce(r["type"] == "request", F.lit(False))
    return grouped.select(
        F.coalesce("_main", "_least").alias("capture_id"),
        F.get(F.filter("_all", main), F.lit(0)).alias("principal"),
        F.filter("_all", lambda r: asks(r) & ~main(r)).alias("requests"),
        F.filter("_all", lambda r: ~asks(r) & ~main(r)).alias("metadata"),
    )


def round_trip(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of every row of ``pages``, as
    the archives written from them say.

    A null html is an empty payload. Of rows with equal payloads those with the smallest id are
    responses, and the others, rows without an id too if any has one, revisit it. Repeated rows
    are captures of their own. Extra columns play no part. No rows: no rows.
    """
    spark = pages.sparkSession
    folder = f"{shared_folder(spark)}/warc-{uuid.uuid4().hex}"
    write(pages, folder, min_bytes=min_bytes)
    records = read(spark, folder)
    revisit = F.col("type") == "revisit"
    said = F.col("payload").cast("string")
    # What is asked of a payload is worked out where it is read, so payloads do not move.
    light = records.select(
        "record_id", "type", "concurrent_to",
        F.when(F.col("type") == "response", F.octet_length("payload").cast("long")).alias("n_bytes"),
        F.when(revisit, F.col("digest")).when(F.col("type") == "response", payload_digest(F.col("payload"))).alias("digest"),
        F.when(revisit, F.regexp_extract("http", r"(?i)content-length: *(\d+)", 1).cast("long")).alias("said_bytes"),
        F.when(F.col("type") == "metadata", F.regexp_extract(said, r"(?m)^page-id: (-?\d+)", 1)).alias("page"),
        F.when(F.col("type") == "metadata", F.regexp_extract(said, r"(?m)^refers-to-page-id: (-?\d+)", 1)).alias("refers"),
    )
    captures = assemble(cut_lineage(light))  # archives are read once
    kind = pages.schema["page_id"].dataType.simpleString()
    meta = F.get("metadata", 0)
    number = lambda c: F.nullif(c, F.lit("")).cast(kind)
    return captures.select(
        number(meta["page"]).alias("page_id"),
        F.coalesce("principal.n_bytes", "principal.said_bytes").alias("payload_bytes"),
        F.col("principal.digest").alias("payload_digest"),
        F.col("principal.type").alias("record_type"),
        number(meta["refers"]).alias("refers_to"),
    )
