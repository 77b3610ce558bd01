"""The inverted index: one row per (path, source, lexeme) with its frequency."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import headers as H
from ..functions import text as X
from ..functions.lexemes import lexemes
from .errors import InvalidParameter

# Number of lexeme buckets of a stored index; readers prune to the buckets of a query.
INDEX_BUCKETS = 256
# Rows of one file of a stored index.
FILE_ROWS = 1_000_000
# Lexemes that are counted in one step.
LEXEMES_AT_ONCE = 200_000
# Lexemes that the frequency sketch follows, and the most frequent ones that it names.
LEXEMES_TRACKED, LEXEMES_NAMED = 50_000, 2000


def bucket_of(lexeme: Column | str) -> Column:
    return F.pmod(F.xxhash64(lexeme), F.lit(INDEX_BUCKETS)).cast("int")


def index_text(parsed: DataFrame) -> Column:
    """What the index covers of a parsed document: path, metadata and body."""
    return F.concat_ws("\n", "path", F.coalesce("metadata", F.lit("{}")), "body")


def _count_rows(rows: DataFrame, text: Column, language: str, source: str, kind: Column) -> DataFrame:
    """Count lexemes inside each row; the result needs no shuffle.

    Each step is its own column, so that it is computed once per row.
    """
    held = (
        rows.select("path", kind.alias("kind"), text.alias("_text"))
        .select("path", "kind", X.lower("_text").alias("_low"))
        .select("path", "kind", lexemes(X.bag_of_lower("_low"), language).alias("lexemes"))
        .filter("lexemes IS NOT NULL")
    )
    return held.mapInArrow(_count_lexemes, "path string, kind string, lexeme string, tf int").select(
        "path", F.lit(source).alias("source"), "kind", "lexeme", "tf"
    )


def _count_lexemes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From (path, kind, lexemes) to (path, kind, lexeme, tf), several rows at a time."""
    for batch in batches:
        ends = np.cumsum(pc.list_value_length(batch["lexemes"]).to_numpy(), dtype=np.int64)
        cuts = [0, *(np.flatnonzero(np.diff(ends // LEXEMES_AT_ONCE)) + 1).tolist(), batch.num_rows]
        for part in (batch.slice(a, b - a) for a, b in zip(cuts, cuts[1:]) if b > a):
            coded = part["lexemes"].flatten().dictionary_encode()
            size = max(len(coded.dictionary), 1)
            pairs = pc.list_parent_indices(part["lexemes"]).to_numpy().astype(np.int64) * size + coded.indices.to_numpy()
            pairs, counts = np.unique(pairs, return_counts=True)
            row, lexeme = pa.array(pairs // size), pa.array(pairs % size)
            columns = [part["path"].take(row), part["kind"].take(row), coded.dictionary.take(lexeme), pa.array(counts, pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, ["path", "kind", "lexeme", "tf"])


def text_postings(files: DataFrame, language: str) -> DataFrame:
    parsed = H.parse_headers(files.select("path", "content"))
    return _count_rows(parsed, index_text(parsed), language, "text", F.lit("file"))


def summary_postings(summaries: DataFrame, language: str) -> DataFrame:
    """Postings of abstracts and overviews; ``kind`` tells documents from directories."""
    text = F.concat_ws("\n", "abstract", "overview")
    return _count_rows(summaries, text, language, "summary", F.col("kind"))


def build_index(
    files: DataFrame,
    language: str,
    summaries: DataFrame | None = None,
    skip_rejected: bool = False,
) -> DataFrame:
    """Postings of a whole corpus.

    A document with a wrong header fails the build, so that an index is complete or does
    not exist; with ``skip_rejected`` such documents are left out instead.
    """
    parsed = H.parse_headers(files.select("path", "content"))
    if skip_rejected:
        parsed = parsed.filter(F.col("metadata_error").isNull())
    else:
        suspects = files.filter(H.opens_header("path", "content")).select("path", "content")
        bad = H.quarantine(H.parse_headers(suspects))[1].select("path", "metadata_error").first()
        if bad:
            raise InvalidParameter(f"{bad.path}: {bad.metadata_error}")
    postings = _count_rows(parsed, index_text(parsed), language, "text", F.lit("file"))
    if summaries is not None:
        postings = postings.unionByName(summary_postings(summaries, language))
    return postings


def heavy_lexemes(postings: DataFrame, rows: int = FILE_ROWS, tracked: int = LEXEMES_TRACKED, named: int = LEXEMES_NAMED) -> DataFrame:
    """(lexeme, n): the lexemes with more than ``rows`` postings, with their exact number.

    A sketch of bounded size, merged over tasks, names the candidates: it overstates a
    frequency by at most 3.5 / (tracked / 0.75) of all postings, and what it does not follow has no more than
    that.  Where this is not below ``rows``, or all that it names are heavy, every lexeme is counted instead.
    """
    named = min(named, tracked)
    total, found = postings.agg(
        F.count(F.lit(1)), F.expr(f"approx_top_k(lexeme, {named}, {tracked})")
    ).first()
    candidates = [r["item"] for r in found or [] if r["count"] > rows]
    sure = total * 3.5 * 0.75 / tracked < rows and len(candidates) < named
    kept = postings.filter(F.col("lexeme").isin(candidates)) if sure else postings
    return kept.groupBy("lexeme").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > rows)


def file_parts(postings: DataFrame, rows: int = FILE_ROWS) -> DataFrame:
    """Postings with ``bucket``, ``owner`` and ``part``: the rows of one file share all three.

    A heavy lexeme owns files in proportion to its rows and is dealt over them by path.  The other lexemes
    of a bucket are dealt over its files by lexeme, so that each stays in one.
    """
    from ..session import broadcast_if_small, durable

    heavy = durable(heavy_lexemes(postings, rows), "heavy").select(
        "lexeme", F.ceil(F.col("n") / rows).alias("salts")
    )
    dealt = postings.withColumn("bucket", bucket_of("lexeme")).join(broadcast_if_small(heavy), "lexeme", "left")
    light = durable(
        dealt.filter("salts is null").groupBy("bucket").agg(F.ceil(F.count(F.lit(1)) / rows).alias("files")), "light"
    )
    # at most one row per bucket
    dealt = dealt.join(F.broadcast(light), "bucket", "left")
    is_heavy = F.col("salts").isNotNull()
    return dealt.select(
        *postings.columns, "bucket", F.when(is_heavy, F.col("lexeme")).alias("owner"),
        F.when(is_heavy, F.pmod(F.xxhash64("path"), F.col("salts")))
        .otherwise(F.pmod(F.hash("lexeme"), F.col("files"))).alias("part"),
    )


def write_index(postings: DataFrame, folder: str, rows: int = FILE_ROWS) -> None:
    """Store postings by lexeme bucket, sorted by lexeme inside each file of at most ``rows`` rows.

    Each task writes one range of (bucket, lexeme, path) of about ``rows`` rows, so that its memory does not grow with
    the postings, however frequent a lexeme is; their number does.
    """
    from ..session import durable, forget

    made = durable(postings, "postings")  # counted and dealt without splitting the texts again
    tasks = max(int(made.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-made.count() // rows))
    (
        made.withColumn("bucket", bucket_of("lexeme"))
        .repartitionByRange(tasks, "bucket", "lexeme", "path")
        .sortWithinPartitions("bucket", "lexeme", "path")
        .write.mode("overwrite")
        .option("maxRecordsPerFile", rows)
        .partitionBy("bucket")
        .parquet(folder)
    )
    forget(made)


def read_index(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(folder)


def update_index(
    postings: DataFrame, touched: DataFrame, files: DataFrame, language: str
) -> DataFrame:
    """Postings after a batch: rows of the touched paths go, the current ones come.

    ``touched`` holds the changed and deleted paths of the batch.  A touched document that is
    not in ``files`` is deleted, and its summary goes too.
    """
    from ..session import broadcast_if_small, pick

    paths = touched.select("path").distinct()
    kept = postings.filter("source = 'text'").join(broadcast_if_small(paths), "path", "left_anti")
    fresh = text_postings(pick(files, paths), language)
    deleted = paths.join(files.select("path"), "path", "left_anti")
    others = postings.filter("source <> 'text'").join(broadcast_if_small(deleted), "path", "left_anti")
    return kept.select(fresh.columns).unionByName(fresh).unionByName(others.select(fresh.columns))


def manifest(files: DataFrame, language: str) -> DataFrame:
    """What an index covers: (path, content_hash, language)."""
    return files.select("path", "content_hash", F.lit(language).alias("language"))


def index_status(files: DataFrame, manifest_rows: DataFrame, language: str) -> DataFrame:
    """One row: documents in total, those missing from the index or in another language, and
    index entries without a document."""
    return (
        files.select("path", F.lit(True).alias("here"))
        .join(manifest_rows.select("path", "language"), "path", "full")
        .agg(
            F.count("here").alias("total"),
            F.count_if(
                F.col("here") & (F.col("language").isNull() | (F.col("language") != F.lit(language)))
            ).alias("stale"),
            F.count_if(F.col("here").isNull()).alias("orphans"),
        )
    )


def settings(files: DataFrame, manifest_rows: DataFrame, language: str, enabled: bool) -> DataFrame:
    """Language, whether summaries are made, and the index status as one row."""
    return index_status(files, manifest_rows, language).select(
        F.lit(language).alias("language"), F.lit(enabled).alias("summary_enabled"), "total", "stale"
    )
