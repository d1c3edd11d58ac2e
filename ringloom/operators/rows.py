"""Row-wise Arrow maps for rows that carry rasters."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

FLUSH_BYTES = 32 << 20
ROWS_AT_ONCE = 16
_ARROW = {"string": pa.string(), "int": pa.int32(), "bigint": pa.int64(), "double": pa.float64(), "binary": pa.binary()}


def map_rows(df: DataFrame, draw: Callable[[dict], dict | None], schema: str) -> DataFrame:
    """One output row, or none, per input row, in Arrow batches.

    Batches are cut by bytes, not rows: a task holds a few rasters however large they are.
    """

    def some(row: dict) -> list[dict]:
        made = draw(row)
        return [] if made is None else [made]

    return map_rows_many(df, some, schema)


def map_rows_many(df: DataFrame, draw: Callable[[dict], Iterable[dict]], schema: str) -> DataFrame:
    """Any number of output rows per input row."""
    fields = [part.split() for part in schema.split(", ")]
    layout = pa.schema([(name, _ARROW[kind]) for name, kind in fields])

    def flush(rows: list[dict]) -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist(rows, schema=layout)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, weight = [], 0
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS_AT_ONCE):
                for row in batch.slice(start, ROWS_AT_ONCE).to_pylist():
                    for made in draw(row):
                        held.append(made)
                        weight += sum(len(v) for v in made.values() if isinstance(v, bytes))
                        if weight >= FLUSH_BYTES:
                            yield flush(held)
                            held, weight = [], 0
        if held:
            yield flush(held)

    return df.mapInArrow(run, schema)
