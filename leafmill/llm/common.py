"""Registry and small helpers of this subpackage."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: Bytes of text that a task handles in one step.
STEP_BYTES = 1 << 20


def query(name: str, sql: str | None = None):
    def register(run):
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return run

    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def text_steps(
    batches: Iterable[pa.RecordBatch], step_bytes: int = STEP_BYTES
) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Slices of (key columns..., text) batches with their texts as bytes; null is the empty text.

    A slice holds about ``step_bytes`` of text, so the memory of a task does not follow the
    number of rows in a batch.
    """
    for batch in batches:
        texts = batch.column(batch.num_columns - 1).cast(pa.binary())
        at, size = 0, 0
        for i in range(batch.num_rows):
            size += len(texts[i].as_buffer() or b"") if texts[i].is_valid else 0
            if size >= step_bytes or i + 1 == batch.num_rows:
                yield batch.slice(at, i + 1 - at), [t or b"" for t in texts.slice(at, i + 1 - at).to_pylist()]
                at, size = i + 1, 0


def rows_of(schema: pa.Schema, *columns) -> pa.RecordBatch:
    arrays = [
        c if isinstance(c, (pa.Array, pa.ChunkedArray)) else pa.array(c, type=f.type)
        for c, f in zip(columns, schema, strict=True)
    ]
    return pa.RecordBatch.from_arrays(arrays, schema=schema)
