"""Append-only logs of answers and grades (JSON lines)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RECORD_SCHEMA = (
    "id string, scope string, group string, question string, gold string, response string, "
    "input_tokens bigint, output_tokens bigint, cache_read_tokens bigint, tool_calls bigint, "
    "tree_calls bigint, seconds double, error string, correct boolean, reason string"
)


def read_log_lines(spark: SparkSession, path: str, by: str = "name") -> DataFrame:
    """(file, pos, line): the lines of text files with a position that follows their order.

    Files follow each other by name, or by modification time (then name) with ``by="time"``.  The position is
    (place of the file, start of the file block, running number), so it does not depend on
    how files are put together or split into tasks.
    """
    if by not in ("name", "time"):
        raise ValueError("by must be name or time")
    time = F.col("_metadata.file_modification_time") if by == "time" else F.lit(None).cast("timestamp")
    return (
        spark.read.text(path)
        .select(
            F.col("_metadata.file_path").alias("file"),
            F.struct(
                time.alias("time"),
                F.col("_metadata.file_path").alias("file"),
                F.col("_metadata.file_block_start").alias("block"),
                F.monotonically_increasing_id().alias("row"),
            ).alias("pos"),
            F.col("value").alias("line"),
        )
        .filter(F.trim("line") != "")
    )


def read_records(spark: SparkSession, path: str, schema: str = RECORD_SCHEMA, by: str = "name") -> DataFrame:
    parsed = F.from_json("line", schema, {"mode": "FAILFAST"})
    return latest_records(read_log_lines(spark, path, by).select("pos", parsed.alias("r")).select("pos", "r.*"))


def latest_records(records: DataFrame, key: str = "id", position: str = "pos") -> DataFrame:
    """The last record of each key, at the position of its first one.

    One aggregation with a partial phase: a key with very many records sends one row per
    task.
    """
    others = [c for c in records.columns if c not in (key, position)]
    return (
        records.groupBy(key)
        .agg(
            F.min(position).alias(position),
            F.max_by(F.struct(*others), F.col(position)).alias("_last"),
        )
        .select(key, position, "_last.*")
    )
