"""Document tables built from raw tables, and their storage."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import paths as P
from ..functions import text as X

# Turns of one conversation that make one session document.
SESSION_TURNS = 500


# Tables with long texts and the key that spreads them.
TEXT_KEYS = {"documents": "doc_id", "pages": "page_id"}


def read_table(spark: SparkSession, folder: str, table: str) -> DataFrame:
    rows = spark.read.parquet(f"{folder}/{table}.parquet")
    return spread(rows, TEXT_KEYS[table]) if table in TEXT_KEYS else rows


def spread(rows: DataFrame, key: str) -> DataFrame:
    """Use all cores for a scan that has fewer tasks than cores, such as one small file.

    A large table has more tasks than the cluster has cores and is not moved.
    """
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores, key) if rows.rdd.getNumPartitions() < cores else rows


def with_file_columns(df: DataFrame) -> DataFrame:
    """(path, content, mtime) -> files: adds title, size in bytes, hash and revision."""
    return df.select(
        "path",
        P.name("path").alias("title"),
        "content",
        F.octet_length("content").cast("bigint").alias("size"),
        "mtime",
        X.content_hash("content").alias("content_hash"),
        F.lit(1).cast("bigint").alias("revision"),
    )


def _minutes_after(year: int, month: int, minutes: Column) -> Column:
    """An instant that does not depend on the time zone of the session."""
    start = int(datetime(year, month, 1, tzinfo=timezone.utc).timestamp())
    return F.timestamp_seconds(F.lit(start) + minutes * 60)


def instant(ts: Column | str) -> Column:
    """A wall-clock column (with or without time zone) read as UTC."""
    ts = F.col(ts) if isinstance(ts, str) else ts
    start = F.expr("timestamp_ntz'1970-01-01 00:00:00'")
    return F.timestamp_micros(F.timestamp_diff("MICROSECOND", start, ts.cast("timestamp_ntz")))


def document_files(documents: DataFrame) -> DataFrame:
    return with_file_columns(
        documents.select(
            F.concat(
                F.lit("/corpus/"), "source", F.lit("/"), "lang", F.lit("/"),
                F.col("doc_id").cast("string"), F.lit(".md"),
            ).alias("path"),
            F.col("text").alias("content"),
            _minutes_after(2024, 1, F.col("doc_id")).alias("mtime"),
        )
    )


def page_files(pages: DataFrame) -> DataFrame:
    host = F.regexp_extract("url", "^[a-z]+://([^/?#]+)", 1)
    return with_file_columns(
        pages.select(
            F.concat(
                F.lit("/web/"), host, F.lit("/"), F.col("page_id").cast("string"), F.lit(".html")
            ).alias("path"),
            F.col("html").alias("content"),
            _minutes_after(2024, 2, F.col("page_id")).alias("mtime"),
        )
    )


def session_number(turn: Column | str) -> Column:
    turn = F.col(turn) if isinstance(turn, str) else turn
    return F.floor(turn / F.lit(SESSION_TURNS)).cast("int") + 1


def conversation_files(turns: DataFrame) -> DataFrame:
    """One document per session, lines ``[role]: text`` in turn order.

    A session holds at most ``SESSION_TURNS`` turns, so a group stays bounded also when
    one conversation holds a large part of the table.
    """
    session = session_number("turn")
    line = F.concat(F.lit("["), "role", F.lit("]: "), "text")
    return with_file_columns(
        turns.groupBy("conv_id", session.alias("session"))
        .agg(F.array_sort(F.collect_list(F.struct("turn", line.alias("line")))).alias("turns"))
        .select(
            F.format_string("/conversations/%d/session-%02d.md", "conv_id", "session").alias("path"),
            F.array_join(F.transform("turns", lambda t: t.line), "\n").alias("content"),
            _minutes_after(2024, 3, F.col("conv_id")).alias("mtime"),
        )
    )


def corpus(spark: SparkSession, folder: str) -> DataFrame:
    """All documents, pages and conversations as one files table."""
    return (
        document_files(read_table(spark, folder, "documents"))
        .unionByName(page_files(read_table(spark, folder, "pages")))
        .unionByName(conversation_files(read_table(spark, folder, "conversations")))
    )


def listing(files: DataFrame) -> DataFrame:
    """Paths with size and time; the content column is not read."""
    return files.select("path", "size", "mtime")


def below_prefix(files: DataFrame, scope: str) -> DataFrame:
    """Paths and content strictly below a directory (prefix filter in the scan)."""
    return files.filter(P.below("path", scope)).select("path", "content")


def fill_parent(rows: DataFrame) -> DataFrame:
    """Give rows of an older table their missing parent column value."""
    known = F.col("parent") if "parent" in rows.columns else F.lit("")
    return rows.withColumn(
        "parent",
        F.when((F.coalesce(known, F.lit("")) == "") & (F.col("path") != "/"), P.parent("path"))
        .otherwise(F.coalesce(known, F.lit(""))),
    )


def write_files(files: DataFrame, folder: str) -> None:
    """Write the tree partitioned by its first component, clustered by path."""
    top = F.split("path", "/", 3)[1]
    (
        files.withColumn("top", top)
        .repartitionByRange("top", "path")
        .sortWithinPartitions("path")
        .write.mode("overwrite")
        .partitionBy("top")
        .parquet(folder)
    )


def export_tree(files: DataFrame, folder: str) -> None:
    """Write the documents as JSON lines below one folder per top directory."""
    (
        files.select(F.split("path", "/", 3)[1].alias("top"), "path", "content")
        .write.mode("overwrite")
        .partitionBy("top")
        .json(folder)
    )


def read_files(spark: SparkSession, folder: str, scope: str = "/") -> DataFrame:
    """A stored tree, or the part of it below a scope.

    The first component of the scope prunes partitions; the prefix itself is pushed to the
    Parquet scan, whose files are clustered by path.
    """
    rows = spark.read.option("mergeSchema", "true").parquet(folder)
    if scope not in ("", "/"):
        rows = rows.filter((F.col("top") == scope.split("/")[1]) & P.under("path", scope))
    return rows.drop("top")
