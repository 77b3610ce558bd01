"""Concatenate and cut: documents become one long row of ids, cut into windows of equal length.

First pass: every task encodes its documents, numbers their ids from its own zero and writes
them with its partition's number.  The partitions' totals (one row per task) are summed up to
global offsets.  Second pass: every document knows its place in the long row and cuts itself at
the windows' borders.  Nothing but the totals meets in one task, and only the last window is
not full.

Defined results: null is the empty text, which is the closing id alone.  Rows without ``doc_id`` are packed
like others; repeated rows are packed once per row; an empty table has no pieces.  Other columns
are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import durable
from .common import query, rows_of, table, text_steps
from .tokens import Library

LENGTH = 1024
CLOSING = 0

_ENCODED = pa.schema(
    [("part", pa.int32()), ("place", pa.int64()), ("doc_id", pa.int64()), ("doc_tokens", pa.int64()), ("ids", pa.binary())]
)
_PIECES = pa.schema(
    [("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("doc_tokens", pa.int64()),
     ("sequence_id", pa.int64()), ("offset", pa.int64()), ("ids", pa.binary())]
)


def encoded(documents: DataFrame, vocabulary: str, closing: int = CLOSING) -> DataFrame:
    """The first pass: (part, place, doc_id, doc_tokens, ids), ids as 16-bit numbers where they fit, else 32-bit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        library, part, place = Library(vocabulary), TaskContext.get().partitionId(), 0
        kind = id_kind(len(library.lengths))
        for rows, texts in text_steps(batches):
            ids = [np.array([*library.ids(t.decode()), closing], dtype=kind) for t in texts]
            sizes = [len(i) for i in ids]
            places = place + np.cumsum([0, *sizes])
            place = int(places[-1])
            yield rows_of(_ENCODED, [part] * len(ids), places[:-1], rows.column(0).cast(pa.int64()), sizes, [i.tobytes() for i in ids])

    return documents.select("doc_id", F.col("text").cast("string")).mapInArrow(
        run, "part int, place long, doc_id long, doc_tokens long, ids binary"
    )


def id_kind(n_ids: int) -> str:
    return "<u2" if n_ids <= 1 << 16 else "<u4"


def pack(documents: DataFrame, vocabulary: str, length: int = LENGTH, closing: int = CLOSING) -> DataFrame:
    """Pieces (doc_id, start, length, doc_tokens, sequence_id, offset, ids as little-endian 32-bit numbers).

    A piece with ``start`` > 0 continues a document that a border has cut.
    """
    rows = durable(encoded(documents, vocabulary, closing), "encoded")
    totals = rows.groupBy("part").agg(F.sum("doc_tokens").alias("total"))
    bases = totals.select("part", (F.sum("total").over(Window.orderBy("part")) - F.col("total")).alias("base"))
    # one row per task of the first pass: bounded by the number of tasks, not by the rows
    placed = rows.join(F.broadcast(bases), "part").select(
        (F.col("base") + F.col("place")).alias("place"), "doc_id", "doc_tokens", "ids"
    )
    return placed.mapInArrow(
        lambda batches: _cut(batches, length),
        "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary",
    )


def _cut(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            out: list[tuple] = []
            for place, doc_id, n, ids in zip(*(c.to_pylist() for c in batch.slice(at, 256).columns), strict=True):
                wide = np.frombuffer(ids, dtype="<u2" if len(ids) == 2 * n else "<u4").astype("<u4")
                start = 0
                while start < n:
                    sequence, offset = divmod(place + start, length)
                    size = min(n - start, length - offset)
                    out.append((doc_id, start, size, n, sequence, offset, wide[start : start + size].tobytes()))
                    start += size
            yield rows_of(_PIECES, *zip(*out, strict=True))


def digests(pieces: DataFrame) -> DataFrame:
    """The pieces with the CRC-32 of their ids in place of the ids."""
    return pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids")


@query("op8_concatenate_and_cut")
def op8_concatenate_and_cut(spark, folder):
    return digests(pack(table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json")))
