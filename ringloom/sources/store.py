"""Files in a store: listing folders in tasks, and writing files that appear only once all are written.

A root is a plain path or a URI (``file:``, ``s3a:``, ``gs:``, ``hdfs:`` and whatever else PyArrow's
file systems reach from the executors). Nothing here lists or moves files on the driver.
"""

from __future__ import annotations

import re
import shutil
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ringloom.functions.paths import plain_root
from ringloom.operators.lineage import cut_lineage

COPY_BYTES = 8 << 20
PENDING = ".pending-"  # names that begin with a dot are nobody's files
FILE_COLUMNS = "rel string, content binary, source string"


@dataclass(frozen=True)
class Store:
    """A root folder; names are relative to it."""

    root: str

    @cached_property
    def _at(self) -> tuple[fs.FileSystem, str]:
        scheme, _, rest = self.root.partition(":")
        if not re.match(r"^[A-Za-z][A-Za-z0-9+.-]*:", self.root) or scheme == "file":
            return fs.LocalFileSystem(), plain_root(self.root)
        if scheme in ("s3", "s3a", "s3n"):
            return fs.S3FileSystem(), rest.strip("/")
        system, path = fs.FileSystem.from_uri(self.root)
        return system, path.rstrip("/")

    def _path(self, rel: str) -> str:
        return f"{self._at[1]}/{rel}" if rel else self._at[1]

    def exists(self, rel: str = "") -> bool:
        return self._at[0].get_file_info(self._path(rel)).type != fs.FileType.NotFound

    def children(self, rel: str = "") -> Iterator[tuple[str, bool, int]]:
        """(name, is a folder, bytes) of what lies in a folder, but for names that begin with a dot."""
        for info in self._at[0].get_file_info(fs.FileSelector(self._path(rel))):
            if not info.base_name.startswith("."):
                yield info.base_name, info.type == fs.FileType.Directory, info.size or 0

    def open(self, rel: str):
        return self._at[0].open_input_stream(self._path(rel))

    def read(self, rel: str) -> bytes:
        with self.open(rel) as stream:
            return stream.read()

    def create(self, rel: str):
        """An output stream; the folders above are made."""
        path = self._path(rel)
        self._at[0].create_dir(path.rpartition("/")[0], recursive=True)
        return self._at[0].open_output_stream(path)

    def make(self) -> None:
        """The folder itself, if it is not there."""
        self._at[0].create_dir(self._path(""), recursive=True)

    def copy(self, rel: str, source: Store, name: str) -> None:
        """A file of another store, in pieces."""
        with source.open(name) as given, self.create(rel) as out:
            shutil.copyfileobj(given, out, COPY_BYTES)

    def move(self, old: str, new: str) -> None:
        """Rename, replacing; a repeated call, after the first has moved it, does nothing."""
        if not self.exists(old) and self.exists(new):
            return
        self._at[0].create_dir(self._path(new).rpartition("/")[0], recursive=True)
        self._at[0].move(self._path(old), self._path(new))

    def remove(self, rel: str = "") -> None:
        if self.exists(rel):
            self._at[0].delete_dir(self._path(rel))


# Listing ----------------------------------------------------------------------------------


def list_tree(spark: SparkSession, root: str, below: tuple[str, ...] = ("",)) -> DataFrame:
    """``(path, rel, size)`` of every file below the folders ``below`` of ``root``.

    Level by level: the folders of a level are rows, each listed in a task, and what they hold are
    rows again. Names that begin with a dot are passed over with all inside them, all others are
    returned, those that begin with ``_`` included.
    """
    store = Store(root)
    if not store.exists():
        raise ValueError(f"no folder {root}")

    def look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for folder in batch["rel"]:
                head = f"{folder}/" if folder else ""
                rows = [(head + name, inner, size) for name, inner, size in store.children(folder)]
                yield pd.DataFrame(rows, columns=["rel", "inner", "size"])

    level = spark.createDataFrame([(b,) for b in below], "rel string")
    found = None
    while True:
        seen = cut_lineage(level.repartition("rel").mapInPandas(look, "rel string, inner boolean, size long"))
        files = seen.where(~F.col("inner")).select("rel", "size")
        found = files if found is None else found.unionByName(files)
        level = seen.where("inner").select("rel")
        if level.isEmpty():
            break
    base = plain_root(root)
    return found.select(F.concat(F.lit(f"{base}/"), "rel").alias("path"), "rel", "size")


# Writing ----------------------------------------------------------------------------------


def _write(store: Store, origin: Store):
    """Writes rows ``(rel, content, source, more)``, one file each, to a folder of a task attempt's own, whose
    name is what it returns.

    ``content`` is written; where it is null the file at ``source`` below ``origin`` is copied in pieces.
    A row with ``more`` goes on with the file of the row before it.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        folder, out, written = uuid.uuid4().hex, None, False
        try:
            for batch in batches:
                for rel, content, source, more in zip(*batch.columns, strict=True):
                    written = True
                    if not more.as_py():
                        out = out and out.close()
                        name = f"{folder}/{rel.as_py()}"
                        if not content.is_valid:
                            store.copy(name, origin, source.as_py())
                            continue
                        out = store.create(name)
                    out.write(content.as_buffer())
            if out:
                out.close()
        except BaseException:
            store.remove(folder)
            raise
        if written:
            yield pa.record_batch({"folder": [folder]})

    return write


def tasks_of(spark: SparkSession) -> int:
    """Tasks among which files are dealt by name: a number that is given is not coalesced, however
    few bytes the names have."""
    return 2 * spark.sparkContext.defaultParallelism


def write_files(files: DataFrame, root: str, origin: str | None = None) -> None:
    """Write ``files`` (rel, content) or (rel, content, source) below ``root``, replacing files.

    First a job writes all of them aside, below ``root`` but under a name that begins with a dot. Only
    when every task is done a second job renames them into place, one task for a share of the
    names; a rename that is repeated does nothing, so a lost executor is no fault there. If the
    first job fails, ``root`` is as it was. ``source`` names files below ``origin`` to be copied. With a
    column ``more`` a file may be several rows that follow each other in a partition.
    """
    spark = files.sparkSession
    if "source" not in files.columns:
        files = files.withColumn("source", F.lit(None).cast("string"))
    if "more" not in files.columns:
        files = files.withColumn("more", F.lit(False))
    pending = f"{PENDING}{uuid.uuid4().hex}"
    staging, store = f"{root.rstrip('/')}/{pending}", Store(root)
    rows = files.select("rel", "content", "source", "more")
    try:
        # Of the attempts of a task only the one that counts is in the result.
        done = rows.mapInArrow(_write(Store(staging), Store(origin or root)), "folder string").collect()
        tasks = tuple(r["folder"] for r in done)
        store.make()
        if tasks:

            def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
                for batch in batches:
                    for rel in batch["rel"]:
                        store.move(f"{pending}/{rel}", rel.partition("/")[2])
                    yield pd.DataFrame({"n": [len(batch)]})

            written = list_tree(spark, staging, tasks).select("rel").repartition(tasks_of(spark), "rel")
            written.mapInPandas(place, "n long").agg(F.sum("n")).collect()
    finally:
        store.remove(pending)


# Names that Spark's sources pass over -------------------------------------------------------

# What Spark's file sources take for bookkeeping, beside names with a leading dot.
_PASSED_OVER = r"(^|/)(_[^=/]*|[^/]*\._COPYING_)(/|$)"


def passed_over(rel: Column) -> Column:
    return F.rlike(rel, F.lit(_PASSED_OVER))


def reveal(spark: SparkSession, root: str, listing: DataFrame, folder: str) -> str | None:
    """Copies of the files of ``listing`` (path, rel) that Spark's sources would pass over, in
    ``folder`` under names with a letter before each part; ``revealed_rel`` gives the name back. None
    if there are none."""
    hidden = listing.where(passed_over(F.col("rel")))
    if hidden.isEmpty():
        return None
    copies = hidden.select(shown_rel(F.col("rel")).alias("rel"), F.lit(None).cast("binary").alias("content"), F.col("rel").alias("source"))
    write_files(copies, folder, root)
    return folder


def shown_rel(rel: Column) -> Column:
    return F.concat(F.lit("v"), F.replace(rel, F.lit("/"), F.lit("/v")))


def revealed_rel(rel: Column) -> Column:
    return F.regexp_replace(rel, "(^|/)v", "$1")
