"""Registry of the queries, and the SQL that rebuilds the shared inputs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import paths as P
from ..sources import corpus as C

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(run):
        def wide_integers(spark: SparkSession, folder: str) -> DataFrame:
            """The result with all integers as bigint, the type of SQL counts."""
            rows = run(spark, folder)
            return rows.select(
                *[
                    F.col(f.name).cast("bigint").alias(f.name) if f.dataType.typeName() == "integer" else f.name
                    for f in rows.schema.fields
                ]
            )

        QUERIES[name] = wide_integers
        if sql is not None:
            ORACLES[name] = sql
        return run

    return register


# --- shared inputs ----------------------------------------------------------------


def files(spark: SparkSession, folder: str) -> DataFrame:
    return C.corpus(spark, folder)


def mtime_seconds(column: str = "mtime"):
    return F.unix_seconds(column).alias("mtime_s")


def benchmark_queries(spark: SparkSession, folder: str) -> DataFrame:
    return C.read_table(spark, folder, "benchmark").select(
        F.col("item_id").alias("query_id"), F.col("text").alias("query")
    )


def first_texts(corpus: DataFrame) -> DataFrame:
    """Summary rows made of the first and the last line of documents, and of each leaf directory's
    smallest first line."""
    documents = corpus.select(
        "path",
        F.lit("file").alias("kind"),
        F.substring_index("content", "\n", 1).alias("abstract"),
        F.substring_index("content", "\n", -1).alias("overview"),
        F.when(F.col("size") % 3 == 0, F.lit("stale")).otherwise(F.lit("ready")).alias("status"),
    )
    dirs = corpus.groupBy(P.parent("path").alias("path")).agg(
        F.min(F.substring_index("content", "\n", 1)).alias("abstract")
    )
    return documents.unionByName(
        dirs.select(
            "path",
            F.lit("dir").alias("kind"),
            "abstract",
            F.lit("").alias("overview"),
            F.when(F.length("path") % 2 == 0, F.lit("stale")).otherwise(F.lit("ready")).alias("status"),
        )
    ).withColumn("parent", P.parent("path")).withColumn("language", F.lit("zh"))


def write_log(spark: SparkSession, folder: str) -> DataFrame:
    """Events as writes: (seq, path, ts, content)."""
    return C.read_table(spark, folder, "events").select(
        F.col("event_id").alias("seq"),
        F.concat(
            F.lit("/users/"), F.col("user_id").cast("string"), F.lit("/"), "event_type", F.lit(".md")
        ).alias("path"),
        C.instant("ts").alias("ts"),
        F.concat_ws(" ", "event_type", "props").alias("content"),
    )


# --- the same inputs in SQL -------------------------------------------------------

FILES = """
files AS (
  SELECT path, content, mtime, strlen(content) AS size, 'sha256:' || sha256(content) AS content_hash,
         regexp_replace(path, '^.*/', '') AS name, regexp_replace(path, '/[^/]*$', '') AS parent
  FROM (
    SELECT '/corpus/' || source || '/' || lang || '/' || doc_id || '.md' AS path, text AS content,
           TIMESTAMP '2024-01-01' + doc_id * INTERVAL 1 MINUTE AS mtime FROM documents
    UNION ALL
    SELECT '/web/' || regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) || '/' || page_id || '.html', html,
           TIMESTAMP '2024-02-01' + page_id * INTERVAL 1 MINUTE FROM pages
    UNION ALL
    SELECT printf('/conversations/%d/session-%02d.md', conv_id, turn // 500 + 1),
           string_agg('[' || role || ']: ' || text, chr(10) ORDER BY turn),
           TIMESTAMP '2024-03-01' + conv_id * INTERVAL 1 MINUTE
    FROM conversations GROUP BY conv_id, turn // 500
  )
)"""

DIRS = """
dirs AS (
  SELECT DISTINCT CASE WHEN i = 1 THEN '/' ELSE array_to_string(parts[1:i], '/') END AS path
  FROM (SELECT parts, unnest(range(1, len(parts))) AS i
        FROM (SELECT DISTINCT string_split(path, '/') AS parts FROM files))
)"""

NODES = """
nodes AS (
  SELECT path, parent, name, 'file' AS kind, size, mtime, content_hash FROM files
  UNION ALL
  SELECT path,
         CASE WHEN path = '/' THEN '' WHEN path NOT LIKE '/%/%' THEN '/' ELSE regexp_replace(path, '/[^/]*$', '') END,
         CASE WHEN path = '/' THEN '/' ELSE regexp_replace(path, '^.*/', '') END,
         'dir', 0, NULL, NULL
  FROM dirs
)"""

LINES = """
lines AS (
  SELECT path, generate_subscripts(parts, 1) AS line, unnest(parts) AS text
  FROM (SELECT path, string_split(content, chr(10)) AS parts FROM files)
)"""

SUMMARIES = """
summaries AS (
  SELECT path, 'file' AS kind, split_part(content, chr(10), 1) AS abstract, split_part(content, chr(10), -1) AS overview,
         CASE WHEN size % 3 = 0 THEN 'stale' ELSE 'ready' END AS status, parent FROM files
  UNION ALL
  SELECT parent, 'dir', min(split_part(content, chr(10), 1)), '', CASE WHEN length(parent) % 2 = 0 THEN 'stale' ELSE 'ready' END,
         CASE WHEN parent NOT LIKE '/%/%' THEN '/' ELSE regexp_replace(parent, '/[^/]*$', '') END
  FROM files GROUP BY parent
)"""

TERMS = r"""
terms AS (
  SELECT DISTINCT item_id AS query_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{Nd}]+')) AS term FROM benchmark
)"""

TEXT_POSTINGS = r"""
text_postings AS (
  SELECT path, 'text' AS source, 'file' AS kind, lexeme, count(*) AS tf
  FROM (SELECT path, unnest(regexp_extract_all(lower(path || chr(10) || '{}' || chr(10) || content), '[\p{L}\p{Nd}]+')) AS lexeme
        FROM files)
  GROUP BY path, lexeme
)"""

SUMMARY_POSTINGS = r"""
summary_postings AS (
  SELECT path, 'summary' AS source, kind, lexeme, count(*) AS tf
  FROM (SELECT path, kind, unnest(regexp_extract_all(lower(abstract || chr(10) || overview), '[\p{L}\p{Nd}]+')) AS lexeme
        FROM summaries)
  GROUP BY path, kind, lexeme
)"""

MATCHES = """
matches AS (
  SELECT query_id, path, kind, count(DISTINCT lexeme) AS matched,
         coalesce(sum(tf) FILTER (source = 'text'), 0) AS text_positions,
         coalesce(sum(tf) FILTER (source = 'summary'), 0) AS summary_positions
  FROM (SELECT * FROM text_postings UNION ALL SELECT * FROM summary_postings) JOIN terms ON lexeme = term
  GROUP BY query_id, path, kind
)"""

CANDIDATES = """
candidates AS (
  SELECT query_id, path, matched, summary_positions / (summary_positions + 10.0) AS rank,
         row_number() OVER (PARTITION BY query_id ORDER BY matched DESC, summary_positions DESC, path) AS place
  FROM matches WHERE kind = 'dir' AND path <> '/'
)"""

FOUND = """
lifts AS (
  SELECT m.query_id, m.path, max(c.rank) AS lift FROM matches m JOIN candidates c
    ON c.query_id = m.query_id AND starts_with(m.path, c.path || '/') WHERE m.kind = 'file' GROUP BY ALL
),
found AS (
  SELECT m.query_id, m.path, m.matched,
         text_positions / (text_positions + 10.0) + 0.5 * (summary_positions / (summary_positions + 10.0))
           + 0.25 * coalesce(l.lift, 0) AS score
  FROM matches m LEFT JOIN lifts l ON l.query_id = m.query_id AND l.path = m.path WHERE m.kind = 'file'
)"""

SEARCH = ",".join(
    (FILES, SUMMARIES, TERMS, TEXT_POSTINGS, SUMMARY_POSTINGS, MATCHES, CANDIDATES, FOUND)
)
