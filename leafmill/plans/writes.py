"""Batch writes, summaries and streams over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import headers as H
from ..functions import paths as P
from ..functions import text as X
from ..operators import index as I
from ..operators import mutate as M
from ..operators import summaries as S
from ..operators import tree as T
from ..session import durable, scratch_path
from ..sources import corpus as C
from ..streaming import changes as CH
from ..streaming import dirty as D
from .base import DIRS, FILES, NODES, SUMMARIES, files, first_texts, query, write_log



def as_requests(rows: DataFrame, **columns) -> DataFrame:
    """Fill a request table: missing columns are null."""
    wanted = [part.split() for part in M.REQUEST_SCHEMA.split(", ")]
    have = set(rows.columns)
    return rows.withColumns(columns).select(
        *[
            (F.col(name) if name in have or name in columns else F.lit(None)).cast(kind).alias(name)
            for name, kind in wanted
        ]
    )


def log_puts(spark, sf) -> DataFrame:
    return as_requests(write_log(spark, sf), op=F.lit("put"))


# --- batch writes -----------------------------------------------------------------

LOG = """log AS (SELECT event_id AS seq, '/users/' || user_id || '/' || event_type || '.md' AS path, ts, event_type || ' ' || props AS content FROM events)"""
LOG_RESULT = f"""WITH {LOG} SELECT path, 'sha256:' || sha256(arg_max(content, seq)) AS content_hash, strlen(arg_max(content, seq)) AS size, count(*) AS revision FROM log GROUP BY path"""


@query("write_put_log", LOG_RESULT)
def _(spark, sf):
    empty = files(spark, sf).limit(0)
    return M.apply(empty, log_puts(spark, sf))[0].select("path", "content_hash", "size", "revision")


def document_requests(spark, sf) -> DataFrame:
    """One conditional request per document, of all three kinds and all conditions."""
    base = C.document_files(C.read_table(spark, sf, "documents")).select(
        "path", "content_hash", F.regexp_extract("path", r"(\d+)\.md\z", 1).cast("bigint").alias("seq")
    )
    n = F.col("seq")
    return as_requests(
        base,
        op=F.when(n % 3 == 0, F.lit("put")).when(n % 3 == 1, F.lit("edit")).otherwise(F.lit("delete")),
        path=F.when(n % 11 == 0, F.concat("path", F.lit(".new.md"))).otherwise(F.col("path")),
        content=F.concat(F.lit("version two of "), n.cast("string")),
        old=F.when(n % 13 == 0, F.lit("")).otherwise(F.lit("the ")),
        new=F.lit("THE "),
        every=n % 2 == 0,
        expected_hash=F.when(n % 5 == 0, F.lit("*")).when(n % 5 == 1, F.col("content_hash")).when(n % 5 == 2, F.lit("sha256:stale")).otherwise(F.lit("")),
        ts=C.instant(F.lit("2025-01-01 00:00:00")),
    )


CONDITIONAL = f"""WITH {FILES}, r AS (
    SELECT d.doc_id AS n, d.text, f.content_hash, CASE WHEN d.doc_id % 11 = 0 THEN f.path || '.new.md' ELSE f.path END AS path, d.doc_id % 11 <> 0 AS present,
      CASE d.doc_id % 3 WHEN 0 THEN 'put' WHEN 1 THEN 'edit' ELSE 'delete' END AS op, d.doc_id % 5 AS cond, (length(text) - length(replace(text, 'the ', ''))) // 4 AS hits
    FROM documents d JOIN files f ON f.path = '/corpus/' || d.source || '/' || d.lang || '/' || d.doc_id || '.md'),
  o AS (SELECT *, CASE
      WHEN op = 'put' THEN CASE WHEN cond = 0 AND present OR cond = 2 OR cond = 1 AND NOT present THEN 'CONFLICT' ELSE 'OK' END
      WHEN op = 'edit' THEN CASE WHEN n % 13 = 0 THEN 'EMPTY_OLD' WHEN NOT present THEN 'NOT_FOUND' WHEN cond IN (0, 2) THEN 'CONFLICT' WHEN hits = 0 THEN 'OLD_NOT_FOUND' ELSE 'OK' END
      ELSE CASE WHEN NOT present THEN 'NOT_FOUND' WHEN cond IN (0, 2) THEN 'CONFLICT' ELSE 'OK' END END AS outcome FROM r)"""


@query(
    "write_outcomes",
    f"""{CONDITIONAL} SELECT n AS seq, op, path, outcome, CASE WHEN op = 'edit' AND outcome = 'OK' THEN CASE WHEN n % 2 = 0 THEN hits ELSE 1 END ELSE 0 END AS replaced FROM o""",
)
def _(spark, sf):
    return M.apply(files(spark, sf), document_requests(spark, sf))[1]


@query(
    "write_result",
    f"""{CONDITIONAL}, ok AS (SELECT * FROM o WHERE outcome = 'OK'), result AS (
        SELECT f.path, f.content, 1 AS revision FROM files f WHERE f.path NOT IN (SELECT path FROM ok)
        UNION ALL
        SELECT path, CASE op WHEN 'put' THEN 'version two of ' || n ELSE CASE WHEN n % 2 = 0 THEN replace(text, 'the ', 'THE ')
            ELSE left(text, position('the ' IN text) - 1) || 'THE ' || substr(text, position('the ' IN text) + 4) END END, CASE WHEN present THEN 2 ELSE 1 END FROM ok WHERE op <> 'delete')
       SELECT path, 'sha256:' || sha256(content) AS content_hash, strlen(content) AS size, revision::BIGINT AS revision FROM result""",
)
def _(spark, sf):
    return M.apply(files(spark, sf), document_requests(spark, sf))[0].select("path", "content_hash", "size", "revision")


@query(
    "write_tree_rules",
    """SELECT doc_id AS seq, CASE doc_id % 4 WHEN 0 THEN 'IS_DIR' WHEN 1 THEN 'NOT_DIR' WHEN 2 THEN 'INVALID_PARAM' ELSE 'OK' END AS outcome FROM documents QUALIFY row_number() OVER (PARTITION BY CASE WHEN doc_id % 4 = 0 THEN source || lang ELSE doc_id::VARCHAR END ORDER BY doc_id) = 1""",
)
def _(spark, sf):
    rows = C.read_table(spark, sf, "documents").select("doc_id", "source", "lang")
    n, folder = F.col("doc_id"), F.concat(F.lit("/corpus/"), "source", F.lit("/"), "lang")
    name = F.concat(folder, F.lit("/"), n.cast("string"))
    path = (
        F.when(n % 4 == 0, folder)
        .when(n % 4 == 1, F.concat(name, F.lit(".md/child.md")))
        .when(n % 4 == 2, F.concat(name, F.lit("/.overview.md")))
        .otherwise(F.concat(F.lit("/fresh/"), n.cast("string"), F.lit(".md")))
    )
    # One request per path: of the requests for a directory, the first one.
    requests = rows.select("doc_id", path.alias("path")).groupBy("path").agg(F.min("doc_id").alias("seq"))
    filled = as_requests(requests, op=F.lit("put"), content=F.lit("x"), ts=C.instant(F.lit("2025-01-01 00:00:00")))
    return M.apply(files(spark, sf), filled)[1].select("seq", "outcome")


@query(
    "write_delete_subtrees",
    f"""WITH {FILES} SELECT path, size FROM files WHERE NOT (starts_with(path, '/corpus/src1/') OR path LIKE '/conversations/%7/%' OR path LIKE '/conversations/%7')""",
)
def _(spark, sf):
    corpus = files(spark, sf)
    roots = T.directories(corpus).filter(
        (F.col("path") == "/corpus/src1") | F.col("path").rlike(r"\A/conversations/\d*7\z")
    )
    requests = as_requests(
        roots.select("path", F.crc32("path").alias("seq")), op=F.lit("delete"), ts=C.instant(F.lit("2025-01-01 00:00:00"))
    )
    return M.apply(corpus, requests)[0].select("path", "size")


EMPTIED = r"^/corpus/(src1|src3)/|^/corpus/src5/en/|^/web/"
BEFORE = FILES.replace("files AS (", "before AS (", 1)


@query(
    "write_emptied_directories",
    f"""WITH {BEFORE}, files AS (SELECT path FROM before WHERE NOT regexp_matches(path, '{EMPTIED}') UNION ALL SELECT '/corpus/src3/en/again.md'), {DIRS} SELECT path FROM dirs""",
)
def _(spark, sf):
    """Directories after each of their documents was deleted on its own, and one was written anew."""
    corpus = files(spark, sf)
    instant = C.instant(F.lit("2025-01-01 00:00:00"))
    gone = corpus.filter(F.col("path").rlike(EMPTIED)).select("path", F.crc32("path").alias("seq"))
    again = corpus.agg(F.lit("/corpus/src3/en/again.md").alias("path"), F.lit(1 << 40).alias("seq"))
    requests = as_requests(gone, op=F.lit("delete"), ts=instant).unionByName(
        as_requests(again, op=F.lit("put"), content=F.lit("x"), ts=instant)
    )
    return T.directories(M.apply(corpus, requests)[0]).select("path")


@query(
    "write_equal_conditions",
    f"""WITH {FILES} SELECT path, k, CASE WHEN k = 0 THEN 'OK' ELSE 'CONFLICT' END AS outcome FROM files, (SELECT unnest([0, 1, 2])::BIGINT AS k) WHERE starts_with(path, '/corpus/')""",
)
def _(spark, sf):
    # Three writers with the same expected hash for every document: one of them wins.
    base = C.document_files(C.read_table(spark, sf, "documents"))
    number = F.regexp_extract("path", r"(\d+)\.md\z", 1).cast("bigint")
    rivals = base.select(
        "path", "content_hash", number.alias("number"), F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("k")
    )
    requests = as_requests(
        rivals, seq=F.col("number") * 3 + F.col("k"), op=F.lit("put"), expected_hash=F.col("content_hash"),
        content=F.concat(F.lit("writer "), F.col("k").cast("string")), ts=C.instant(F.lit("2025-01-01 00:00:00")),
    )
    _, outcomes = M.apply(files(spark, sf), requests)
    return outcomes.select("path", (F.col("seq") % 3).alias("k"), "outcome")


@query(
    "write_changed_paths",
    f"""{CONDITIONAL} SELECT path, op = 'delete' AS deleted FROM o WHERE outcome = 'OK'""",
)
def _(spark, sf):
    corpus = files(spark, sf)
    return M.changed_paths(corpus, M.plan_changes(corpus, document_requests(spark, sf)))


# --- summaries --------------------------------------------------------------------

HASH = lambda c: F.sha2(c, 256)


@query(
    "summary_document_sources",
    f"""WITH {FILES} SELECT path, CASE WHEN b = '' THEN NULL ELSE sha256(b) END AS body_hash FROM (SELECT path, regexp_replace(content, '^\\s+|\\s+$', '', 'g') AS b FROM files)""",
)
def _(spark, sf):
    return S.document_sources(files(spark, sf)).select("path", HASH(F.get("sources", F.lit(0))["body"]).alias("body_hash"))


def _children_sql(limit: int) -> str:
    return f"""WITH {FILES}, {SUMMARIES}, known AS (
        SELECT parent, path, CASE kind WHEN 'file' THEN path ELSE path || '/' END AS shown, abstract,
               CASE WHEN kind = 'file' AND overview <> '' THEN overview ELSE abstract END AS long_text FROM summaries),
      sized AS (SELECT *, sum(strlen(shown) + strlen(long_text)) OVER (PARTITION BY parent) AS long_bytes FROM known WHERE long_text <> ''),
      bodies AS (SELECT *, CASE WHEN long_bytes > {limit} AND abstract <> '' THEN abstract ELSE long_text END AS body FROM sized),
      running AS (SELECT *, sum(strlen(shown) + strlen(body)) OVER (PARTITION BY parent ORDER BY path) AS bytes, row_number() OVER (PARTITION BY parent ORDER BY path) AS n, count(*) OVER (PARTITION BY parent) AS total FROM bodies)
      SELECT parent, n, shown AS path, body FROM running WHERE bytes <= {limit}
      UNION ALL
      SELECT parent, count(*) FILTER (bytes <= {limit}) + 1, '', (any_value(total) - count(*) FILTER (bytes <= {limit})) || ' more children are not in this list.' FROM running GROUP BY parent HAVING count(*) FILTER (bytes <= {limit}) < any_value(total)"""


def _flat(sources: DataFrame) -> DataFrame:
    return sources.select("parent", F.posexplode("sources").alias("n", "s")).select(
        "parent", (F.col("n") + 1).alias("n"), "s.path", "s.body"
    )


@query("summary_child_sources", _children_sql(S.MAX_SOURCE_BYTES))
def _(spark, sf):
    return _flat(S.child_sources(first_texts(files(spark, sf))))


@query("summary_child_sources_cut", _children_sql(2500))
def _(spark, sf):
    return _flat(S.child_sources(first_texts(files(spark, sf)), 2500))


def _level_sql(name: str, below: str, children: str) -> str:
    """One directory level of the extractive roll-up in SQL."""
    limit = S.MAX_SOURCE_BYTES
    return f"""{name}_known AS (SELECT parent, path, CASE kind WHEN 'file' THEN path ELSE path || '/' END AS shown, abstract,
          CASE WHEN kind = 'file' AND overview <> '' THEN overview ELSE abstract END AS long_text FROM ({children})),
        {name}_sized AS (SELECT *, sum(strlen(shown) + strlen(long_text)) OVER (PARTITION BY parent) AS long_bytes FROM {name}_known WHERE long_text <> ''),
        {name}_bodies AS (SELECT *, CASE WHEN long_bytes > {limit} AND abstract <> '' THEN abstract ELSE long_text END AS body FROM {name}_sized),
        {name}_running AS (SELECT *, sum(strlen(shown) + strlen(body)) OVER (PARTITION BY parent ORDER BY path) AS bytes, count(*) OVER (PARTITION BY parent) AS total FROM {name}_bodies),
        {name}_sources AS (SELECT parent, path AS ord, shown, body FROM {name}_running WHERE bytes <= {limit}
          UNION ALL SELECT parent, '~', '', (any_value(total) - count(*) FILTER (bytes <= {limit})) || ' more children are not in this list.' FROM {name}_running GROUP BY parent HAVING count(*) FILTER (bytes <= {limit}) < any_value(total)),
        {below} AS (SELECT parent AS path, 'dir' AS kind,
            left(trim(arg_min(split_part(body, chr(10), 1), ord), ' ' || chr(9) || chr(10) || chr(13)), 256) AS abstract,
            left(trim(string_agg('- ' || shown || ': ' || split_part(body, chr(10), 1), chr(10) ORDER BY ord), ' ' || chr(9) || chr(10) || chr(13)), 8000) AS overview,
            CASE WHEN parent = '/' THEN '' WHEN parent NOT LIKE '/%/%' THEN '/' ELSE regexp_replace(parent, '/[^/]*$', '') END AS parent FROM {name}_sources GROUP BY parent)"""


# Directories of the corpus lie on levels 3, 2, 1 and 0.
ROLLUP = f"""WITH {FILES}, docs AS (SELECT path, 'file' AS kind, left(trim(split_part(b, chr(10), 1), ' ' || chr(9) || chr(13)), 256) AS abstract,
      left(trim('- ' || path || ': ' || split_part(b, chr(10), 1), ' ' || chr(9) || chr(13)), 8000) AS overview, parent
      FROM (SELECT path, parent, regexp_replace(content, '^\\s+|\\s+$', '', 'g') AS b FROM files) WHERE b <> ''),
    {_level_sql('l3', 'd3', "SELECT * FROM docs WHERE len(string_split(path, '/')) = 5")},
    {_level_sql('l2', 'd2', "SELECT * FROM docs WHERE len(string_split(path, '/')) = 4 UNION ALL BY NAME SELECT * FROM d3")},
    {_level_sql('l1', 'd1', "SELECT * FROM d2")},
    {_level_sql('l0', 'd0', "SELECT * FROM d1")},
    everything AS (SELECT * FROM docs UNION ALL BY NAME SELECT * FROM d3 UNION ALL BY NAME SELECT * FROM d2 UNION ALL BY NAME SELECT * FROM d1 UNION ALL BY NAME SELECT * FROM d0)"""


def first_rollup(spark, sf) -> DataFrame:
    return S.rollup(files(spark, sf), "zh").summaries


@query("summary_rollup", f"{ROLLUP} SELECT path, kind, 'ready' AS status, abstract, sha256(overview) AS overview_hash FROM everything")
def _(spark, sf):
    return first_rollup(spark, sf).select("path", "kind", "status", "abstract", HASH("overview").alias("overview_hash"))


@query("summary_refresh_calls")
def _(spark, sf):
    """Paths for which the generator runs after every tenth document changed."""
    corpus = files(spark, sf)
    first = S.rollup(corpus, "zh").summaries
    touched = F.crc32("path") % 10 == 0
    after = corpus.withColumn("content", F.when(touched, F.concat(F.lit("new start\n"), "content")).otherwise(F.col("content")))
    changes = corpus.filter(touched).select("path", F.lit(False).alias("deleted"))
    result = S.rollup(after, "zh", S.invalidate(first, changes, "zh"))
    return result.calls


@query("summary_unchanged_calls", "SELECT 'calls' AS what, 0::BIGINT AS n UNION ALL SELECT 'stale', 0")
def _(spark, sf):
    """A write of equal text makes paths stale, but no input changes."""
    corpus = files(spark, sf)
    first = S.rollup(corpus, "zh").summaries
    stale = S.invalidate(first, corpus.select("path", F.lit(False).alias("deleted")), "zh")
    result = S.rollup(corpus, "zh", stale)
    called = result.calls.agg(F.lit("calls").alias("what"), F.count(F.lit(1)).alias("n"))
    return called.unionByName(
        result.summaries.agg(F.lit("stale").alias("what"), F.count_if(F.col("status") != "ready").alias("n"))
    )


FORCED = "starts_with(path, '/corpus/src3/') AND kind = 'dir'"


@query("summary_forced_calls", f"WITH {FILES}, {DIRS}, {NODES} SELECT path FROM nodes WHERE {FORCED}")
def _(spark, sf):
    corpus = files(spark, sf)
    first = S.rollup(corpus, "zh").summaries
    forced = T.nodes(corpus).filter(P.below("path", "/corpus/src3") & (F.col("kind") == "dir")).select("path")
    return S.rollup(corpus, "zh", first, force_paths=forced).calls


@query(
    "summary_failures",
    f"""WITH {FILES} SELECT path, CASE WHEN size % 7 = 0 THEN 'failed' ELSE 'ready' END AS status, CASE WHEN size % 7 = 0 THEN 3 ELSE 0 END::BIGINT AS attempts,
        CASE WHEN size % 7 = 0 THEN 'no answer' ELSE '' END AS error FROM files""",
)
def _(spark, sf):
    """A generator that never answers for some documents."""
    corpus = files(spark, sf)
    broken = corpus.filter("size % 7 = 0").select("path", F.lit(True).alias("broken"))

    def sometimes(requests: DataFrame) -> DataFrame:
        good = S.extractive(requests).join(broken, "path", "left")
        return good.select(
            "path", F.col("broken").isNull().alias("ok"), "abstract", "overview",
            F.when(F.col("broken"), F.lit("no answer")).alias("error"),
        )

    result = S.rollup(corpus, "zh", generate=sometimes).summaries
    return result.filter("kind = 'file'").select("path", "status", "attempts", "error")


@query(
    "summary_python_generator",
    f"""WITH {FILES} SELECT path, regexp_replace(left(regexp_replace(content, '^\\s+|\\s+$', '', 'g'), 40), '\\s+$', '') AS abstract FROM files""",
)
def _(spark, sf):
    def make(request):
        body = request["sources"][0]["body"]
        return body[:40], f"{len(request['sources'])} sources"

    result = S.rollup(files(spark, sf), "zh", generate=S.python_generator(make)).summaries
    return result.filter("kind = 'file'").select("path", "abstract")


@query(
    "summary_dirty",
    f"""WITH {FILES}, w AS (SELECT path, size % 9 = 0 AS deleted FROM files WHERE size % 9 <= 1),
       parts AS (SELECT string_split(path, '/') AS p, deleted FROM w),
       hit AS (SELECT CASE WHEN i = 1 THEN '/' ELSE array_to_string(p[1:i], '/') END AS path FROM (SELECT p, unnest(range(1, len(p) + CASE WHEN deleted THEN 0 ELSE 1 END)) AS i FROM parts))
       SELECT DISTINCT path FROM hit""",
)
def _(spark, sf):
    kind = F.col("size") % 9
    writes = files(spark, sf).filter(kind <= 1).select("path", (kind == 0).alias("deleted"))
    return S.dirty_paths(writes)


@query(
    "summary_invalidate",
    f"""WITH {FILES}, {SUMMARIES}, w AS (SELECT path FROM files WHERE size % 9 = 1),
       parts AS (SELECT string_split(path, '/') AS p, 0 AS cut FROM w UNION ALL SELECT ['', 'corpus', 'src2', ''], 1),
       hit AS (SELECT DISTINCT CASE WHEN i = 1 THEN '/' ELSE array_to_string(p[1:i], '/') END AS path FROM (SELECT p, unnest(range(1, len(p) + 1 - cut - cut)) AS i FROM parts))
       SELECT coalesce(s.path, h.path) AS path, CASE WHEN h.path IS NOT NULL THEN 'stale' ELSE s.status END AS status
       FROM (SELECT * FROM summaries WHERE NOT (path = '/corpus/src2' OR starts_with(path, '/corpus/src2/'))) s FULL JOIN hit h ON h.path = s.path""",
)
def _(spark, sf):
    corpus = files(spark, sf)
    rows = first_texts(corpus).withColumns(
        {"source_hash": F.lit(""), "error": F.lit(""), "attempts": F.lit(0), "updated_at": F.lit(None).cast("timestamp")}
    )
    gone = spark.range(1).select(F.lit("/corpus/src2").alias("path"), F.lit(True).alias("deleted"))
    changes = corpus.filter("size % 9 = 1").select("path", F.lit(False).alias("deleted")).unionByName(gone)
    return S.invalidate(rows, changes, "zh").select("path", "status")


PARTIAL = "size % 4 <> 0"


def some_summaries(spark, sf):
    """Summaries that lack some documents, with failed rows and rows in another language."""
    corpus = files(spark, sf)
    rows = first_texts(corpus.filter(PARTIAL)).join(corpus.select("path", "size"), "path", "left")
    return corpus, rows.select(
        "path", "kind", "abstract", "overview", "parent",
        F.when(F.col("size") % 4 == 1, F.lit("failed")).otherwise(F.lit("ready")).alias("status"),
        F.when(F.col("size") % 4 == 2, F.lit("en")).otherwise(F.lit("zh")).alias("language"),
    )


BACKFILL = f"""WITH {FILES}, {DIRS}, have AS (SELECT DISTINCT parent AS path FROM files WHERE {PARTIAL} UNION SELECT path FROM files WHERE size % 4 = 3),
       need AS (SELECT path FROM (SELECT path FROM files UNION SELECT path FROM dirs) WHERE path NOT IN (SELECT path FROM have) AND starts_with(path, '/corpus/')),
       hit AS (SELECT CASE WHEN i = 1 THEN '/' ELSE array_to_string(p[1:i], '/') END AS path FROM (SELECT string_split(path, '/') AS p, unnest(range(1, len(string_split(path, '/')) + 1)) AS i FROM need))
       SELECT DISTINCT path FROM hit WHERE path = '/corpus' OR starts_with(path, '/corpus/')"""


@query("summary_backfill", BACKFILL)
def _(spark, sf):
    corpus, rows = some_summaries(spark, sf)
    return S.backfill(T.nodes(corpus), rows, "zh", "/corpus")


@query(
    "summary_status",
    f"""WITH {FILES}, {DIRS}, {NODES} SELECT n.path || CASE WHEN n.kind = 'file' AND n.size % 8 = 5 THEN '.none' ELSE '' END AS path,
          CASE WHEN n.kind = 'file' AND n.size % 8 = 5 THEN 'NOT_FOUND'
               WHEN n.kind = 'file' THEN CASE n.size % 4 WHEN 0 THEN 'missing' WHEN 1 THEN 'failed' WHEN 2 THEN 'stale' ELSE 'ready' END
               WHEN n.path IN (SELECT parent FROM files WHERE {PARTIAL}) THEN 'ready' ELSE 'missing' END AS status FROM nodes n""",
)
def _(spark, sf):
    corpus, rows = some_summaries(spark, sf)
    tree = T.nodes(corpus)
    none = (F.col("kind") == "file") & (F.col("size") % 8 == 5)
    requests = tree.select(F.when(none, F.concat("path", F.lit(".none"))).otherwise(F.col("path")).alias("path"))
    filled = rows.withColumns({"source_hash": F.lit(""), "error": F.lit("")})
    return S.status(requests, tree, filled, "zh").select("path", "status")


@query(
    "summary_sidecars",
    f"""WITH {FILES}, {SUMMARIES} SELECT path || '/.abstract.md' AS path, '---' || chr(10) || 'directory: ' || path || chr(10) || 'generated_by: leafmill' || chr(10) || 'language: zh' || chr(10) || 'source_hash: sha256:0' || chr(10) || 'status: ' || status || chr(10) || '---' || chr(10) || chr(10) || abstract || chr(10) AS content
        FROM summaries WHERE kind = 'dir' AND abstract <> ''""",
)
def _(spark, sf):
    rows = first_texts(files(spark, sf)).withColumn("source_hash", F.lit("sha256:0"))
    return S.sidecars(rows).select("path", "content")


@query(
    "summary_without_vanished",
    f"""WITH {FILES}, {SUMMARIES} SELECT path FROM summaries s WHERE path IN (SELECT path FROM files WHERE size % 6 <> 0) OR EXISTS (SELECT 1 FROM files f WHERE f.size % 6 <> 0 AND starts_with(f.path, s.path || '/'))""",
)
def _(spark, sf):
    corpus = files(spark, sf)
    return S.without_vanished(first_texts(corpus), T.nodes(corpus.filter("size % 6 <> 0"))).select("path")


@query(
    "summary_ready_jobs",
    f"""WITH {FILES}, {SUMMARIES} SELECT path FROM summaries s WHERE status = 'stale' AND NOT EXISTS (SELECT 1 FROM summaries c WHERE c.parent = s.path AND c.status = 'stale')""",
)
def _(spark, sf):
    return S.ready_jobs(first_texts(files(spark, sf))).select("path")


# --- streams ----------------------------------------------------------------------


def event_stream(spark, sf) -> DataFrame:
    """The events table as a stream of writes."""
    events = spark.read.parquet(f"{sf}/events.parquet").schema
    rows = spark.readStream.schema(events).option("pathGlobFilter", "events.parquet").parquet(sf)
    return rows.select(
        F.col("event_id").alias("seq"),
        F.concat(F.lit("/users/"), F.col("user_id").cast("string"), F.lit("/"), "event_type", F.lit(".md")).alias("path"),
        C.instant("ts").alias("ts"),
        F.concat_ws(" ", "event_type", "props").alias("content"),
    )


def ingested(spark, sf):
    folder = scratch_path(spark, "ingest")
    base = durable(files(spark, sf).limit(0), "base")
    CH.ingest(as_requests(event_stream(spark, sf), op=F.lit("put")), base, folder, "zh").awaitTermination()
    return base, folder


@query("stream_ingest", LOG_RESULT)
def _(spark, sf):
    base, folder = ingested(spark, sf)
    return CH.current_files(base, folder).select("path", "content_hash", "size", "revision")


@query(
    "stream_index",
    rf"""WITH {LOG}, last AS (SELECT path, arg_max(content, seq) AS content FROM log GROUP BY path)
       SELECT path, lexeme, count(*) AS tf FROM (SELECT path, unnest(regexp_extract_all(lower(path || ' ' || content), '[\p{{L}}\p{{Nd}}]+')) AS lexeme FROM last) GROUP BY ALL""",
)
def _(spark, sf):
    base, folder = ingested(spark, sf)
    return CH.current_postings(I.text_postings(base, "zh"), folder).select("path", "lexeme", "tf")


def _bursts_sql(seconds: int) -> str:
    return f"""WITH {LOG}, w AS (SELECT CASE WHEN i = 1 THEN '/' ELSE array_to_string(p[1:i], '/') END AS path, ts FROM (SELECT string_split(path, '/') AS p, ts, unnest(range(1, len(string_split(path, '/')) + 1)) AS i FROM log)),
      g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY path ORDER BY ts) <= INTERVAL {seconds} SECOND THEN 0 ELSE 1 END AS start FROM w),
      b AS (SELECT *, sum(start) OVER (PARTITION BY path ORDER BY ts ROWS UNBOUNDED PRECEDING) AS burst FROM g),
      bursts AS (SELECT path, epoch_us(min(ts)) AS first_us, epoch_us(max(ts)) AS last_us, count(*) AS writes, epoch_us(max(ts) + INTERVAL {seconds} SECOND) AS due_us FROM b GROUP BY path, burst)"""


def _micros(rows: DataFrame) -> DataFrame:
    return rows.select(
        "path", F.unix_micros("first_write").alias("first_us"), F.unix_micros("last_write").alias("last_us"), "writes",
        F.unix_micros("due").alias("due_us"),
    )


@query("stream_bursts", f"{_bursts_sql(3600)} SELECT * FROM bursts")
def _(spark, sf):
    return _micros(D.bursts(write_log(spark, sf), 3600))


@query("stream_bursts_default_delay", f"{_bursts_sql(2)} SELECT * FROM bursts")
def _(spark, sf):
    return _micros(D.bursts(write_log(spark, sf)))


@query(
    "stream_debounce",
    f"""{_bursts_sql(3600)} SELECT * FROM bursts WHERE due_us <= (SELECT epoch_ms(max(ts)) - 600000 FROM events) * 1000""",
)
def _(spark, sf):
    """Bursts that the watermark has passed at the end of the stream."""
    folder = scratch_path(spark, "debounce")
    query_ = (
        D.debounce(event_stream(spark, sf).select("path", "ts"), "3600 seconds")
        .writeStream.format("parquet")
        .option("path", f"{folder}/out")
        .option("checkpointLocation", f"{folder}/checkpoint")
        .trigger(availableNow=True)
        .start()
    )
    query_.awaitTermination()
    return _micros(spark.read.parquet(f"{folder}/out"))


@query("stream_dirty_jobs")
def _(spark, sf):
    """Jobs with explicit state; the timers that the watermark has passed."""
    folder = scratch_path(spark, "dirty")
    schema = "path string, version bigint, last_write timestamp, due timestamp"
    query_ = (
        D.dirty_jobs(event_stream(spark, sf).select("path", "ts"), 3600)
        .writeStream.format("parquet")
        .outputMode("append")
        .option("path", f"{folder}/out")
        .option("checkpointLocation", f"{folder}/checkpoint")
        .trigger(availableNow=True)
        .start()
    )
    query_.awaitTermination()
    return spark.read.schema(schema).parquet(f"{folder}/out")
