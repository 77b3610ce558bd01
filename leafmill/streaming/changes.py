"""Continuous ingest of write requests, with the derived index kept in step.

Each micro-batch writes only its changes, below a folder named by the batch id.  A replayed
batch overwrites its own folder, so a restart does not apply it twice.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import paths as P
from ..operators import index as I
from ..operators import mutate as M
from ..session import broadcast_if_small, pick, shared_folder

_UPSERTS = (
    "path string, title string, content string, size bigint, mtime timestamp, "
    "content_hash string, revision bigint, batch_id bigint"
)
_REMOVED = "path string, batch_id bigint"
_POSTINGS = "path string, source string, kind string, lexeme string, tf int, batch_id bigint"


def _read(spark: SparkSession, folder: str, part: str, schema: str, before: int | None) -> DataFrame:
    """Rows of one kind of change from all batches (or those before one)."""
    try:
        rows = spark.read.schema(schema).parquet(f"{folder}/{part}")
    except AnalysisException:  # no batch has written such rows yet
        return spark.createDataFrame([], schema)
    return rows if before is None else rows.filter(F.col("batch_id") < before)


def read_changes(spark: SparkSession, folder: str, before: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(upserts, removed) with their batch ids."""
    return (
        _read(spark, folder, "upserts", _UPSERTS, before),
        _read(spark, folder, "removed", _REMOVED, before),
    )


def current_files(base: DataFrame, folder: str, before: int | None = None) -> DataFrame:
    """The files table after all batches: the newest row of each path, unless a later batch
    removed it or a directory above it."""
    spark = base.sparkSession
    upserts, removed = read_changes(spark, folder, before)
    others = [c for c in M.FILE_COLUMNS if c != "path"]
    newest = (
        upserts.groupBy("path")
        .agg(F.max_by(F.struct("batch_id", *others), "batch_id").alias("row"))
        .select("path", "row.*")
    )
    killers = removed.groupBy("path").agg(F.max("batch_id").alias("gone")).withColumnRenamed("path", "root")
    gone = (
        newest.select("path", "batch_id", F.explode(P.ancestors("path", include_self=True)).alias("root"))
        .join(broadcast_if_small(killers), "root")
        .filter(F.col("gone") > F.col("batch_id"))
        .select("path")
        .distinct()
    )
    live = newest.join(gone, "path", "left_anti")
    untouched = M.without_subtrees(base, removed).join(
        broadcast_if_small(newest.select("path")), "path", "left_anti"
    )
    return untouched.select(*M.FILE_COLUMNS).unionByName(live.select(*M.FILE_COLUMNS))


def ingest_batch(base: DataFrame, folder: str, requests: DataFrame, batch_id: int, language: str | None = None) -> None:
    """Apply one batch of requests and store its changes, outcomes and postings."""
    files = current_files(base, folder, before=batch_id)
    changes = M.plan_changes(files, requests)
    for part, rows in (("upserts", changes.upserts), ("removed", changes.removed), ("outcomes", changes.outcomes)):
        rows.write.mode("overwrite").parquet(f"{folder}/{part}/batch_id={batch_id}")
    if language:
        I.text_postings(changes.upserts, language).write.mode("overwrite").parquet(
            f"{folder}/postings/batch_id={batch_id}"
        )


def ingest(
    requests: DataFrame, base: DataFrame, folder: str, language: str | None = None,
    available_now: bool = True,
) -> StreamingQuery:
    """Start the ingest of a request stream (columns of ``mutate.REQUEST_SCHEMA``)."""
    writer = requests.writeStream.foreachBatch(
        lambda rows, batch_id: ingest_batch(base, folder, rows, batch_id, language)
    ).option("checkpointLocation", f"{folder}/checkpoint")
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()


def current_postings(base_postings: DataFrame, folder: str) -> DataFrame:
    """Text postings after all batches, from the postings of each batch."""
    spark = base_postings.sparkSession
    upserts, removed = read_changes(spark, folder)
    fresh = _read(spark, folder, "postings", _POSTINGS, None)
    newest = upserts.groupBy("path").agg(F.max("batch_id").alias("batch_id"))
    live = fresh.join(newest, ["path", "batch_id"], "left_semi")
    killers = removed.groupBy("path").agg(F.max("batch_id").alias("gone")).withColumnRenamed("path", "root")
    gone = (
        newest.select("path", "batch_id", F.explode(P.ancestors("path", include_self=True)).alias("root"))
        .join(broadcast_if_small(killers), "root")
        .filter(F.col("gone") > F.col("batch_id"))
        .select("path")
        .distinct()
    )
    untouched = M.without_subtrees(base_postings, removed).join(
        broadcast_if_small(newest.select("path")), "path", "left_anti"
    )
    columns = ["path", "source", "kind", "lexeme", "tf"]
    return untouched.select(*columns).unionByName(live.join(gone, "path", "left_anti").select(*columns))
