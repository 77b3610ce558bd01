"""Session set-up, shared-folder tables and size-checked broadcasts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_FOLDERS: dict[str, str] = {}
#: Tables that durable() wrote, with their paths.
_WRITTEN: dict[int, tuple[DataFrame, str]] = {}


def local_session(cores: str | int = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A session for tests and benchmarks on one machine."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("leafmill")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors can reach, named by ``spark.checkpoint.dir``.

    Only a local session may run without that setting; it gets a scratch folder.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _FOLDERS:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
        _FOLDERS[app] = tempfile.mkdtemp(prefix="leafmill-")
    return _FOLDERS[app]


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{shared_folder(spark)}/leafmill/{label}-{uuid.uuid4().hex}"


def durable(df: DataFrame, label: str = "table") -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    This cuts the lineage, survives the loss of executors, and keeps column
    pruning and filter pushdown for the readers.  The size of the written files is
    known to the planner, which broadcasts such a table in a join only below
    ``spark.sql.autoBroadcastJoinThreshold``.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    _WRITTEN[id(table)] = (table, path)
    return table


def forget(*tables: DataFrame) -> None:
    """Delete the files of tables that :func:`durable` wrote and nobody reads any more."""
    for table in tables:
        _, path = _WRITTEN.pop(id(table), (None, None))
        if path:
            place = table.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(table.sparkSession._jsc.hadoopConfiguration()).delete(place, True)


def broadcast_if_small(
    df: DataFrame, max_rows: int = 200_000, max_bytes: int = 32 << 20
) -> DataFrame:
    """Mark ``df`` for a broadcast join only after its size has been measured.

    The measurement reads at most ``max_rows + 1`` rows.  A larger table comes back
    without a hint, and the join shuffles both sides on the join key.
    """
    row_bytes = F.octet_length(F.to_json(F.struct(*df.columns)))
    rows, size = (
        df.limit(max_rows + 1)
        .agg(F.count(F.lit(1)), F.coalesce(F.sum(row_bytes), F.lit(0)))
        .first()
    )
    return F.broadcast(df) if rows <= max_rows and size <= max_bytes else df


def pick(rows: DataFrame, keys: DataFrame, column: str = "path", literal_keys: int = 1000) -> DataFrame:
    """Rows whose ``column`` occurs in ``keys``, without moving ``rows`` when avoidable.

    Up to ``literal_keys`` keys become a literal filter, which the Parquet scan uses to skip
    row groups.  More keys become a broadcast semi join when their measured size allows it,
    and a shuffled semi join beyond that.
    """
    wanted = keys.select(column).distinct()
    sample = wanted.limit(literal_keys + 1).collect()
    if len(sample) <= literal_keys:
        return rows.filter(F.col(column).isin([r[0] for r in sample]))
    return rows.join(broadcast_if_small(wanted), column, "left_semi")
