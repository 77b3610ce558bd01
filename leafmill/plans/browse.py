"""Sources, paths, trees, find, glob, grep and line views over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import paths as P
from ..functions import text as X
from ..operators import grep as G
from ..operators import pattern_table as PT
from ..operators import tree as T
from ..operators import view as V
from ..operators.evaluate import with_position
from ..session import scratch_path
from ..sources import corpus as C
from ..sources import records as R
from ..sources import sessions as S
from .base import DIRS, FILES, LINES, NODES, files, mtime_seconds, query

TREE = f"WITH {FILES}, {DIRS}, {NODES}"


# --- sources and sinks ------------------------------------------------------------


@query("source_listing", f"WITH {FILES} SELECT path, size, epoch(mtime)::BIGINT AS mtime_s FROM files")
def _(spark, sf):
    return C.listing(files(spark, sf)).select("path", "size", mtime_seconds())


@query("source_below_prefix", f"WITH {FILES} SELECT path, content FROM files WHERE starts_with(path, '/corpus/src1/')")
def _(spark, sf):
    return C.below_prefix(files(spark, sf), "/corpus/src1")


@query(
    "source_build",
    f"WITH {FILES} SELECT path, name AS title, size, content_hash, 1::BIGINT AS revision FROM files",
)
def _(spark, sf):
    return files(spark, sf).select("path", "title", "size", "content_hash", F.col("revision").cast("int"))


def dialog_samples(spark, sf) -> DataFrame:
    """Conversations in the dialog shape, one sample row per session of bounded length."""
    turns = C.read_table(spark, sf, "conversations")
    session = C.session_number("turn")
    entry = F.struct(
        "turn",
        F.col("role").alias("speaker"),
        F.format_string("D%d:%d", session, F.col("turn") + 1).alias("dia_id"),
        "text",
    )
    grouped = turns.groupBy("conv_id", session.alias("session")).agg(
        F.array_sort(F.collect_list(entry)).alias("turns")
    )
    spoken = F.to_json(F.transform("turns", lambda t: t.dropFields("turn")))
    key = F.concat(F.lit("session_"), F.col("session").cast("string"))
    return grouped.select(
        F.col("conv_id").cast("string").alias("sample_id"),
        F.create_map(
            F.lit("speaker_a"), F.lit("user"), F.lit("speaker_b"), F.lit("assistant"),
            key, spoken, F.concat(key, F.lit("_date_time")), F.format_string("day %d", "session"),
        ).alias("conversation"),
        F.transform(
            "turns",
            lambda t, i: F.struct(
                F.concat(F.lit("What is turn "), i.cast("string"), F.lit("?")).alias("question"),
                t.text.alias("answer"),
                F.array(F.concat(t.dia_id, F.lit("; D"), F.lit("99:1"))).alias("evidence"),
                ((i % 5) + 1).cast("int").alias("category"),
            ),
        ).alias("qa"),
    )


@query(
    "source_dialog_documents",
    """WITH sessions AS (
      SELECT conv_id, turn // 500 + 1 AS s,
             string_agg('[' || role || '] (D' || (turn // 500 + 1) || ':' || (turn + 1) || '): ' || text || chr(10) || chr(10), '' ORDER BY turn) AS body
      FROM conversations GROUP BY conv_id, turn // 500)
    SELECT printf('/conversations/%d/session-%02d.md', conv_id, s) AS path,
      '---' || chr(10) || 'title: "user and assistant, session ' || s || '"' || chr(10) || 'date: "day ' || s || '"' || chr(10)
      || 'tags: [conversation]' || chr(10) || '---' || chr(10) || chr(10) || '# Conversation between user and assistant' || chr(10) || chr(10)
      || 'Date: day ' || s || chr(10) || chr(10) || body AS content FROM sessions""",
)
def _(spark, sf):
    return S.dialog_documents(dialog_samples(spark, sf))


def chat_histories(spark, sf) -> DataFrame:
    """Conversations in the history shape: each turn is a session, the dates repeat and run
    backwards, so that the time order differs from the stored order."""
    turns = C.read_table(spark, sf, "conversations")
    block = C.session_number("turn")
    date = F.format_string("2024/01/%02d", F.lit(30) - F.col("turn") % 7)
    said = F.struct(
        F.col("role").alias("role"), F.col("text").alias("content"), (F.col("turn") % 2 == 1).alias("has_answer")
    )
    return (
        turns.groupBy("conv_id", block.alias("block"))
        .agg(F.array_sort(F.collect_list(F.struct("turn", date.alias("date"), said.alias("said")))).alias("turns"))
        .select(
            F.format_string("c%d-%d", "conv_id", "block").alias("question_id"),
            F.lit("chat").alias("question_type"),
            F.lit("What was said?").alias("question"),
            F.lit("a lot").alias("answer"),
            F.lit("2024/02/01").alias("question_date"),
            F.transform("turns", lambda t: t.date).alias("haystack_dates"),
            F.transform("turns", lambda t: F.array(t.said)).alias("haystack_sessions"),
        )
    )


HISTORY = """turns AS (
      SELECT printf('c%d-%d', conv_id, turn // 500 + 1) AS q, turn, role, text, printf('2024/01/%02d', 30 - turn % 7) AS d,
             row_number() OVER (PARTITION BY conv_id, turn // 500 ORDER BY printf('2024/01/%02d', 30 - turn % 7), turn) AS n
      FROM conversations)"""


@query(
    "source_history_documents",
    f"""WITH {HISTORY} SELECT printf('/conversations/%s/session-%03d.md', q, n) AS path,
      '---' || chr(10) || 'title: "Chat session on ' || d || '"' || chr(10) || 'date: "' || d || '"' || chr(10)
      || 'tags: [conversation]' || chr(10) || '---' || chr(10) || chr(10) || '# Chat session on ' || d || chr(10) || chr(10)
      || '[' || role || ']: ' || text || chr(10) || chr(10) AS content FROM turns""",
)
def _(spark, sf):
    return S.history_documents(chat_histories(spark, sf))[0]


@query("sink_export", f"WITH {FILES} SELECT path, content_hash FROM files")
def _(spark, sf):
    folder = scratch_path(spark, "export")
    C.export_tree(files(spark, sf), folder)
    exported = spark.read.schema("path string, content string").json(folder)
    return exported.select("path", X.content_hash("content").alias("content_hash"))


@query("sink_file_table", f"WITH {FILES} SELECT path, size, content_hash FROM files WHERE starts_with(path, '/web/')")
def _(spark, sf):
    folder = scratch_path(spark, "files")
    C.write_files(files(spark, sf), folder)
    return C.read_files(spark, folder, "/web").select("path", "size", "content_hash")


@query(
    "source_latest_records",
    """SELECT user_id || '/' || event_type AS id, max(event_id) AS seq, max_by(value, event_id) AS value,
       max_by(props, event_id) AS props FROM events GROUP BY user_id, event_type""",
)
def _(spark, sf):
    """The events as a log of several files in a folder, read back by the record reader."""
    log = C.read_table(spark, sf, "events").select(
        F.concat_ws("/", F.col("user_id").cast("string"), "event_type").alias("id"), F.col("event_id").alias("seq"), "value", "props"
    )
    folder = scratch_path(spark, "log")
    log.repartitionByRange("seq").sortWithinPartitions("seq").write.json(folder)
    return R.read_records(spark, folder, "id string, seq bigint, value double, props string").drop("pos")


@query("source_fill_parent", f"{TREE} SELECT path, parent FROM nodes")
def _(spark, sf):
    old = T.nodes(files(spark, sf)).select("path", F.lit("").alias("parent"))
    return C.fill_parent(old)


# --- paths ------------------------------------------------------------------------


@query(
    "path_clean",
    """SELECT url, '/' || array_to_string(list_filter(string_split('.//' || url || '/./x/', '/'), lambda p: p NOT IN ('', '.')), '/') AS cleaned,
       '/a/' || page_id AS up FROM pages""",
)
def _(spark, sf):
    pages = C.read_table(spark, sf, "pages")
    return pages.select(
        "url",
        P.clean(F.concat(F.lit(".//"), "url", F.lit("/./x/"))).alias("cleaned"),
        P.clean(F.concat(F.lit("../a/b/./../"), F.col("page_id").cast("string"), F.lit("/c/.."))).alias("up"),
    )


@query(
    "path_rejects",
    """SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'INVALID_PATH' WHEN 1 THEN 'RESERVED_NAME' WHEN 2 THEN 'ROOT' END AS reason FROM pages""",
)
def _(spark, sf):
    n = F.col("page_id").cast("string")
    raw = (
        F.when(F.col("page_id") % 4 == 0, F.col("url"))
        .when(F.col("page_id") % 4 == 1, F.concat(F.lit("/web/"), n, F.lit("/.abstract.md")))
        .when(F.col("page_id") % 4 == 2, F.concat(F.lit("/"), n, F.lit("/..")))
        .otherwise(F.concat(F.lit("/web/"), n))
    )
    return C.read_table(spark, sf, "pages").select("page_id", P.reject_reason(raw).alias("reason"))


@query(
    "path_parts",
    f"""{TREE} SELECT path, parent, name, len(list_filter(string_split(path, '/'), lambda p: p <> '')) AS depth FROM nodes""",
)
def _(spark, sf):
    return T.nodes(files(spark, sf)).select(
        "path", P.parent("path").alias("parent"), P.name("path").alias("name"), P.depth("path").alias("depth")
    )


@query(
    "path_ancestors",
    f"""WITH {FILES} SELECT path, CASE WHEN i = 1 THEN '/' ELSE array_to_string(parts[1:i], '/') END AS ancestor,
        CASE WHEN i = 1 THEN '' WHEN i = 2 THEN '/' ELSE array_to_string(parts[1:i-1], '/') END AS parent
        FROM (SELECT path, string_split(path, '/') AS parts, unnest(range(1, len(string_split(path, '/')) + 1)) AS i FROM files)""",
)
def _(spark, sf):
    return files(spark, sf).select(
        "path", F.explode(P.ancestors("path", include_self=True)).alias("ancestor")
    ).withColumn("parent", P.parent("ancestor"))


@query(
    "path_under",
    f"""{TREE} SELECT d.path AS scope, count(*) AS documents FROM dirs d JOIN files f
        ON d.path = '/' OR starts_with(f.path, d.path || '/') GROUP BY d.path""",
)
def _(spark, sf):
    # Documents per directory: the equality form of the subtree test.
    return (
        files(spark, sf)
        .groupBy(P.parent("path").alias("parent"))
        .agg(F.count(F.lit(1)).alias("n"))
        .select(F.explode(P.ancestors("parent", include_self=True)).alias("scope"), "n")
        .groupBy("scope")
        .agg(F.sum("n").alias("documents"))
    )


@query(
    "path_hidden",
    f"""WITH {FILES} SELECT path, size % 2 = 0 AS hidden, false AS hidden_below FROM files""",
)
def _(spark, sf):
    dotted = F.concat(
        F.when(F.col("size") % 2 == 0, F.lit("/.cache")).otherwise(F.lit("/cache")), F.col("path")
    )
    return files(spark, sf).select(
        "path", P.hidden(dotted).alias("hidden"), P.hidden(dotted, "/.cache").alias("hidden_below")
    )


# --- trees ------------------------------------------------------------------------


@query("tree_nodes", f"{TREE} SELECT path, parent, name, kind, size, content_hash FROM nodes")
def _(spark, sf):
    return T.nodes(files(spark, sf)).select("path", "parent", "name", "kind", "size", "content_hash")


@query(
    "tree_duplicates",
    """WITH f AS (SELECT '/' || source || CASE WHEN doc_id % 50 = 0 THEN '' ELSE '/' || lang || '/' || (doc_id % 97) END AS path FROM documents)
       SELECT path, 'DUPLICATE' AS problem FROM f GROUP BY path HAVING count(*) > 1
       UNION ALL SELECT DISTINCT path, 'FILE_AND_DIR' FROM f WHERE path NOT LIKE '/%/%' AND EXISTS (SELECT 1 FROM f g WHERE starts_with(g.path, f.path || '/'))""",
)
def _(spark, sf):
    rest = F.concat(F.lit("/"), "lang", F.lit("/"), (F.col("doc_id") % 97).cast("string"))
    raw = F.concat(F.lit("/"), "source", F.when(F.col("doc_id") % 50 == 0, F.lit("")).otherwise(rest))
    return T.duplicate_paths(C.read_table(spark, sf, "documents").select(raw.alias("path")))


@query(
    "tree_from_rows",
    """WITH r AS (SELECT event_id, '/users/' || user_id || '/' || event_type AS path, CASE event_type WHEN 'error' THEN 'link' WHEN 'signup' THEN 'dir' ELSE 'file' END AS kind,
         CAST(floor(value) AS BIGINT) AS size FROM events),
       good AS (SELECT path, arg_max(kind, event_id) AS kind, arg_max(size, event_id) AS size FROM r WHERE kind <> 'link' GROUP BY path)
       SELECT path, kind, size FROM good UNION ALL SELECT DISTINCT regexp_replace(path, '/[^/]*$', ''), 'dir', 0 FROM good
       UNION ALL SELECT '/users', 'dir', 0 UNION ALL SELECT '/', 'dir', 0
       UNION ALL SELECT '(rejected)', 'link', count(*) FROM r WHERE kind = 'link'""",
)
def _(spark, sf):
    kind = (
        F.when(F.col("event_type") == "error", F.lit("link"))
        .when(F.col("event_type") == "signup", F.lit("dir"))
        .otherwise(F.lit("file"))
    )
    rows = C.read_table(spark, sf, "events").select(
        F.col("event_id").alias("pos"),
        F.concat(F.lit("users//"), F.col("user_id").cast("string"), F.lit("/"), "event_type").alias("path"),
        kind.alias("kind"),
        F.floor("value").cast("bigint").alias("size"),
        C.instant("ts").alias("mtime"),
    )
    tree, rejected = T.nodes_from_rows(rows)
    return tree.select("path", "kind", "size").unionByName(
        rejected.agg(
            F.lit("(rejected)").alias("path"), F.lit("link").alias("kind"), F.count(F.lit(1)).alias("size")
        )
    )


def path_requests(spark, sf) -> DataFrame:
    """Requests for documents, directories and paths that do not exist."""
    n, base = F.col("doc_id"), F.concat(F.lit("/corpus/"), "source", F.lit("/"), "lang")
    path = (
        F.when(n % 3 == 0, base)
        .when(n % 3 == 1, F.concat(base, F.lit("/"), n.cast("string"), F.lit(".md")))
        .otherwise(F.concat(base, F.lit("/"), n.cast("string"), F.lit(".txt")))
    )
    return C.read_table(spark, sf, "documents").select("doc_id", path.alias("path"))


REQUESTS = """requests AS (SELECT doc_id, '/corpus/' || source || '/' || lang
   || CASE doc_id % 3 WHEN 0 THEN '' WHEN 1 THEN '/' || doc_id || '.md' ELSE '/' || doc_id || '.txt' END AS path FROM documents)"""


@query(
    "tree_stat",
    f"""{TREE}, {REQUESTS} SELECT doc_id, r.path, kind, size, epoch(mtime)::BIGINT AS mtime_s, content_hash,
        CASE WHEN kind IS NULL THEN 'NOT_FOUND' ELSE 'OK' END AS status FROM requests r LEFT JOIN nodes n ON n.path = r.path""",
)
def _(spark, sf):
    return T.stat(T.nodes(files(spark, sf)), path_requests(spark, sf)).select(
        "doc_id", "path", "kind", "size", mtime_seconds(), "content_hash", "status"
    )


@query(
    "tree_directory_status",
    f"""WITH {REQUESTS} SELECT doc_id, path, CASE doc_id % 3 WHEN 0 THEN 'OK' WHEN 1 THEN 'NOT_DIR' ELSE 'NOT_FOUND' END AS status FROM requests""",
)
def _(spark, sf):
    return T.directory_status(T.nodes(files(spark, sf)), path_requests(spark, sf))


@query(
    "tree_ls",
    f"""{TREE}, shown AS (SELECT path, kind, size FROM nodes WHERE parent = '/corpus')
        (SELECT * FROM shown ORDER BY path LIMIT 15 OFFSET 3) UNION ALL SELECT '(total)', 'total', count(*) FROM shown""",
)
def _(spark, sf):
    tree = T.nodes(files(spark, sf))
    rows = T.ls(tree, "/corpus", limit=15, offset=3).select("path", "kind", "size")
    total = T.total(T.ls_rows(tree, "/corpus"))
    return rows.unionByName(
        total.select(F.lit("(total)").alias("path"), F.lit("total").alias("kind"), F.col("total").alias("size"))
    )


@query(
    "tree_ls_recursive",
    f"""{TREE} SELECT path, kind, row_number() OVER (ORDER BY string_split(path, '/')) AS ord FROM nodes WHERE path <> '/'""",
)
def _(spark, sf):
    rows = T.ls_rows(T.nodes(files(spark, sf)), "/", recursive=True)
    keyed = rows.select("path", "kind", P.preorder("path").alias("key"))
    return with_position(keyed, "key").select("path", "kind", (F.col("position") + 1).alias("ord"))


@query(
    "tree_ls_by_size",
    f"""{TREE} SELECT path, size, row_number() OVER (ORDER BY size DESC, string_split(path, '/')) AS ord FROM nodes WHERE path <> '/'""",
)
def _(spark, sf):
    rows = T.ls_rows(T.nodes(files(spark, sf)), "/", recursive=True)
    keyed = rows.select("path", "size", (-F.col("size")).alias("down"), P.preorder("path").alias("key"))
    return with_position(keyed, "down", "key").select("path", "size", (F.col("position") + 1).alias("ord"))


@query(
    "tree_ls_by_time",
    f"""{TREE} SELECT path, kind, epoch(mtime)::BIGINT AS mtime_s FROM nodes WHERE starts_with(path, '/web/')
        ORDER BY mtime DESC NULLS LAST, string_split(path, '/') LIMIT 40 OFFSET 5""",
)
def _(spark, sf):
    rows = T.ls(T.nodes(files(spark, sf)), "/web", sort="mtime", reverse=True, recursive=True, limit=40, offset=5)
    return rows.select("path", "kind", mtime_seconds())


@query(
    "tree_lines",
    f"""{TREE} SELECT row_number() OVER (ORDER BY string_split(path, '/')) AS ord,
        CASE WHEN path = '/' THEN '/' ELSE repeat('  ', len(string_split(path, '/')) - 1) || name || CASE kind WHEN 'dir' THEN '/' ELSE '' END END AS line
        FROM nodes WHERE path = '/' OR len(string_split(path, '/')) <= 4""".replace(
        "ORDER BY string_split(path, '/')", "ORDER BY path <> '/', string_split(path, '/')"
    ),
)
def _(spark, sf):
    lines = T.tree_lines(T.nodes(files(spark, sf)), "/", depth=3)
    return with_position(lines, "sort_key").select((F.col("position") + 1).alias("ord"), "line")


@query(
    "tree_lines_by_size",
    f"""{TREE} SELECT row_number() OVER (ORDER BY parts[1:-2], kind = 'file', size, name) AS ord,
        repeat('  ', len(parts) - 2) || path || CASE kind WHEN 'dir' THEN '/' ELSE ' [' || size || ']' END AS line
        FROM (SELECT *, string_split(path, '/') AS parts FROM nodes WHERE starts_with(path, '/conversations/'))
        WHERE kind = 'dir'
        UNION ALL SELECT 0, '/conversations'
        """,
)
def _(spark, sf):
    lines = T.tree_lines(
        T.nodes(files(spark, sf)), "/conversations", depth=1, full_path=True, show_size=True,
        sort="size", dirs_first=True,
    )
    return with_position(lines, "sort_key").select(F.col("position").alias("ord"), "line")


@query("tree_adjacency", f"{TREE} SELECT parent, path AS child, kind FROM nodes WHERE path <> '/'")
def _(spark, sf):
    return T.adjacency(T.nodes(files(spark, sf)))


@query(
    "join_binding",
    f"""WITH {FILES} SELECT path, name AS title, size FROM files WHERE starts_with(path, '/corpus/')""",
)
def _(spark, sf):
    documents = C.read_table(spark, sf, "documents")
    bound = C.document_files(documents).select(
        "path", "size", F.regexp_extract("path", r"(\d+)\.md\z", 1).cast("bigint").alias("doc_id")
    )
    titles = documents.select("doc_id", F.concat(F.col("doc_id").cast("string"), F.lit(".md")).alias("title"))
    return bound.join(titles, "doc_id").select("path", "title", "size")


@query(
    "join_ancestor_max",
    f"""{TREE}, sized AS (SELECT parent AS path, count(*) AS n FROM files GROUP BY parent UNION ALL SELECT '/corpus', 3)
        SELECT f.path, max(s.n) AS n FROM files f JOIN sized s ON starts_with(f.path, s.path || '/') GROUP BY f.path""",
)
def _(spark, sf):
    corpus = files(spark, sf)
    sized = corpus.groupBy(P.parent("path").alias("path")).agg(F.count(F.lit(1)).alias("n"))
    extra = spark.range(1).select(F.lit("/corpus").alias("path"), F.lit(3).cast("bigint").alias("n"))
    return T.ancestor_max(corpus, sized.unionByName(extra), "n")


# --- find and glob ----------------------------------------------------------------


@query(
    "find_by_name",
    f"""{TREE} SELECT path, size FROM nodes WHERE kind = 'file' AND starts_with(path, '/corpus/') AND name LIKE '%1.md' AND len(string_split(path, '/')) = 5""",
)
def _(spark, sf):
    tree = T.nodes(files(spark, sf))
    return T.find_rows(tree, "/corpus", name="*1.md", min_depth=3, max_depth=3).select("path", "size")


@query("find_directories", f"{TREE} SELECT path FROM nodes WHERE kind = 'dir' AND name LIKE 'src_'")
def _(spark, sf):
    return T.find_rows(T.nodes(files(spark, sf)), "/", name="src?", kind="dir").select("path")


@query("find_any_kind", f"{TREE} SELECT path, kind FROM nodes WHERE path <> '/' AND len(string_split(path, '/')) <= 3")
def _(spark, sf):
    return T.find_rows(T.nodes(files(spark, sf)), "/", name="*", kind="any", max_depth=2).select("path", "kind")


@query("find_ignore_case", f"{TREE} SELECT path FROM nodes WHERE kind = 'file' AND regexp_matches(name, '^[0-9]*1[0-4]\\.md$')")
def _(spark, sf):
    return T.find_rows(T.nodes(files(spark, sf)), "/", name="unused", iname="*1[0-4].MD").select("path")


@query(
    "find_page",
    f"""{TREE}, shown AS (SELECT path, size FROM nodes WHERE kind = 'file' AND regexp_matches(name, '^[^0-4].*\\.html$'))
        (SELECT * FROM shown ORDER BY path LIMIT 20 OFFSET 10) UNION ALL SELECT '(total)', count(*) FROM shown""",
)
def _(spark, sf):
    tree = T.nodes(files(spark, sf))
    rows = T.find(tree, "/", limit=20, offset=10, name="[^0-4]*.html").select("path", "size")
    total = T.total(T.find_rows(tree, "/", name="[^0-4]*.html"))
    return rows.unionByName(total.select(F.lit("(total)").alias("path"), F.col("total").alias("size")))


@query("glob_paths", f"WITH {FILES} SELECT substr(path, 2) AS path, size FROM files WHERE regexp_matches(path, '^/(.*/)?en/[^/]*7\\.md$')")
def _(spark, sf):
    return T.glob_rows(files(spark, sf), "**/en/*7.md").select("path", "size")


@query(
    "glob_page",
    f"""WITH {FILES} SELECT substr(path, 2) AS path, size, epoch(mtime)::BIGINT AS mtime_s FROM files
        WHERE starts_with(path, '/corpus/src1') ORDER BY path LIMIT 25 OFFSET 5""",
)
def _(spark, sf):
    return T.glob(files(spark, sf), "./corpus/src1**", limit=25, offset=5).select("path", "size", mtime_seconds())


# --- grep -------------------------------------------------------------------------

GREP = f"WITH {FILES}, {LINES} SELECT path, line, text FROM lines WHERE "


def _matches(df):
    return df.select("path", "line", "text")


@query("grep_literal", GREP + "contains(text, 'the ')")
def _(spark, sf):
    return _matches(G.grep(files(spark, sf), "the "))


@query("grep_regex", GREP + "regexp_matches(text, '^[A-Z][a-z]+ (the|on)[^a-z]|[0-9]{4,}')")
def _(spark, sf):
    return _matches(G.grep(files(spark, sf), "^[A-Z][a-z]+ (the|on)[^a-z]|[0-9]{4,}", regex=True))


@query("grep_ignore_case", GREP + "contains(lower(text), 'the on')")
def _(spark, sf):
    return _matches(G.grep(files(spark, sf), "The On", ignore_case=True))


@query("grep_regex_ignore_case", GREP + "regexp_matches(text, '(?i)^TH.*[aeiou]{3}')")
def _(spark, sf):
    return _matches(G.grep(files(spark, sf), "^TH.*[aeiou]{3}", regex=True, ignore_case=True))


@query("grep_whole_word", GREP + "regexp_matches(text, '(^|[^0-9A-Za-z_])the($|[^0-9A-Za-z_])')")
def _(spark, sf):
    return _matches(G.grep(files(spark, sf), "the", whole_word_only=True))


@query("grep_whole_line", GREP + r"regexp_matches(text, '^[A-Z][a-z ]*|\.$')")
def _(spark, sf):
    return _matches(G.grep(files(spark, sf), r"[A-Z][a-z ]*|\.", regex=True, whole_line=True))


@query("grep_invert", GREP + "NOT contains(text, 'e') AND starts_with(path, '/corpus/')")
def _(spark, sf):
    return _matches(G.grep(files(spark, sf), "e", path="/corpus", invert=True))


@query(
    "grep_context",
    f"""WITH {FILES} SELECT path, i AS line, parts[i] AS text, coalesce(array_to_string(parts[greatest(i - 2, 1):i - 1], chr(10)), '') AS before,
        coalesce(array_to_string(parts[i + 1:i + 1], chr(10)), '') AS after
        FROM (SELECT path, parts, unnest(range(1, len(parts) + 1)) AS i FROM (SELECT path, string_split(content, chr(10)) AS parts FROM files))
        WHERE contains(parts[i], 'tion')""",
)
def _(spark, sf):
    return G.grep(files(spark, sf), "tion", before=2, after=1).select(
        "path", "line", "text", F.array_join("before", "\n").alias("before"), F.array_join("after", "\n").alias("after")
    )


@query("grep_include_exclude", GREP + "contains(text, 'the') AND path LIKE '%.md' AND NOT regexp_matches(path, '/[^/]*[13]\\.md$')")
def _(spark, sf):
    return _matches(G.grep(files(spark, sf), "the", include="*.md", exclude="*[13].md"))


@query("grep_files", f"WITH {FILES}, {LINES} SELECT DISTINCT path FROM lines WHERE regexp_matches(text, '[a-z]ing[^a-z]')")
def _(spark, sf):
    return G.grep_files(files(spark, sf), "[a-z]ing[^a-z]", regex=True)


@query("grep_count", f"WITH {FILES}, {LINES} SELECT path, count(*) AS matches FROM lines WHERE contains(text, 'and') GROUP BY path")
def _(spark, sf):
    return G.grep_count(files(spark, sf), "and")


@query(
    "grep_only_matching",
    f"""WITH {FILES}, {LINES} SELECT path, line, 'and' AS text FROM (SELECT path, line, unnest(range(0, (length(text) - length(replace(text, 'and', ''))) // 3)) FROM lines)""",
)
def _(spark, sf):
    return G.grep_only(files(spark, sf), "and")


MANY = ("the on", "error", "http", "tion and", "@")


@query(
    "grep_many",
    f"""WITH {FILES}, {LINES}, p AS (SELECT unnest(['the on', 'error', 'http', 'tion and', '@']) AS pattern)
        SELECT pattern, path, line, text FROM lines JOIN p ON contains(text, pattern)""",
)
def _(spark, sf):
    return G.grep_many(files(spark, sf), MANY)


@query(
    "pattern_checks",
    f"""WITH {FILES}, {LINES}, p AS (SELECT unnest(['a', 'b', 'c']) AS label, unnest(['^the .*on', '[0-9]{{40}}', 'tion\\s+and']) AS pattern)
        SELECT label, pattern, CASE WHEN bool_or(regexp_matches(text, '(?i)' || pattern)) THEN 'PASS' ELSE 'FAIL' END AS status FROM lines, p GROUP BY ALL""",
)
def _(spark, sf):
    checks = [("a", "^the .*on"), ("b", "[0-9]{40}"), ("c", r"tion\s+and")]
    return G.pattern_checks(files(spark, sf), checks)


#: Words of four letters or more; the first two of a document, with one space between them, are a pattern.
WORD_PAIRS = """pairs AS (SELECT DISTINCT w[1] || ' ' || w[2] AS pattern
        FROM (SELECT regexp_extract_all(text, '[A-Za-z]{4,}') AS w FROM documents) WHERE len(w) >= 2)"""


@query(
    "grep_pattern_table",
    f"""WITH {FILES}, {LINES}, {WORD_PAIRS}
        SELECT pattern, length(pattern) % 2 = 0 AS ignore_case, path, line, text FROM lines JOIN pairs
          ON CASE WHEN length(pattern) % 2 = 0 THEN contains(lower(text), lower(pattern)) ELSE contains(text, pattern) END""",
)
def _(spark, sf):
    words = F.regexp_extract_all("text", F.lit("[A-Za-z]{4,}"), F.lit(0))
    pairs = C.read_table(spark, sf, "documents").select(words.alias("w")).filter(F.size("w") >= 2)
    patterns = pairs.select(F.concat_ws(" ", F.col("w")[0], F.col("w")[1]).alias("pattern"))
    patterns = patterns.withColumn("ignore_case", F.length("pattern") % 2 == 0)
    return PT.grep_table(files(spark, sf), patterns, show_all=True).select("pattern", "ignore_case", "path", "line", "text")


@query(
    "pattern_check_table",
    f"""WITH {FILES}, {LINES}, words AS (SELECT item_id, unnest(list_distinct(regexp_extract_all(lower(text), '[a-z]{{6,}}'))) AS w FROM benchmark),
        low AS (SELECT lower(text) AS t FROM lines), ends AS (SELECT DISTINCT w FROM words),
        fits AS (SELECT w, bool_or(starts_with(t, w)) AS first, bool_or(contains(t, w || '.') OR contains(t, w || ',')) AS stop FROM ends JOIN low ON contains(t, w) GROUP BY w)
        SELECT item_id AS label, pattern, CASE WHEN hit THEN 'PASS' ELSE 'FAIL' END AS status FROM (
          SELECT item_id, '^' || w AS pattern, first AS hit FROM words LEFT JOIN fits USING (w)
          UNION ALL SELECT item_id, w || '[.,]', stop FROM words LEFT JOIN fits USING (w)
          UNION ALL SELECT item_id, '^[0-9]{{' || item_id % 7 + 1 || '}}$', (SELECT bool_or(regexp_matches(t, '^[0-9]+$') AND length(t) = item_id % 7 + 1) FROM low) FROM benchmark)""",
)
def _(spark, sf):
    items = C.read_table(spark, sf, "benchmark")
    words = items.select("item_id", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{6,}"), F.lit(0)))).alias("w"))
    label, digits = F.col("item_id").alias("label"), F.format_string("^[0-9]{%d}$", F.col("item_id") % 7 + 1)
    checks = (
        words.select(label, F.concat(F.lit("^"), "w").alias("pattern"))
        .unionByName(words.select(label, F.concat("w", F.lit("[.,]")).alias("pattern")))
        .unionByName(items.select(label, digits.alias("pattern")))
    )
    return PT.check_table(files(spark, sf), checks)


# --- document and line views ------------------------------------------------------


@query(
    "view_cat",
    f"""WITH {FILES}, {REQUESTS} SELECT doc_id, r.path, content_hash, strlen(content) AS body_bytes, CASE WHEN content IS NULL THEN 'NOT_FOUND' ELSE 'OK' END AS status
        FROM requests r LEFT JOIN files f ON f.path = r.path""",
)
def _(spark, sf):
    return V.cat(files(spark, sf), path_requests(spark, sf)).select(
        "doc_id", "path", "content_hash", F.octet_length("body").alias("body_bytes"), "status"
    )


@query(
    "view_changed",
    f"""WITH {FILES} SELECT path, CASE WHEN size % 4 = 0 THEN NULL ELSE content_hash END AS content_hash, status FROM (
          SELECT CASE WHEN size % 4 = 0 THEN path || '.gone' ELSE path END AS path, size, content_hash, CASE size % 4 WHEN 0 THEN 'NOT_FOUND' ELSE 'CHANGED' END AS status FROM files WHERE size % 4 <= 1)""",
)
def _(spark, sf):
    corpus = files(spark, sf)
    kind = F.col("size") % 4
    manifest = corpus.select(
        F.when(kind == 0, F.concat("path", F.lit(".gone"))).otherwise(F.col("path")).alias("path"),
        F.when(kind == 1, F.lit('"sha256:old"'))
        .when(kind == 2, F.concat(F.lit('"x", W/"'), "content_hash", F.lit('"')))
        .otherwise(F.col("content_hash"))
        .alias("if_none_match"),
    )
    return V.changed(corpus, manifest)


SHOWN = f"""WITH {FILES}, shown AS (
   SELECT path, generate_subscripts(parts, 1) AS line, unnest(parts) AS text
   FROM (SELECT path, CASE WHEN ends_with(content, chr(10)) THEN string_split(content, chr(10))[1:-2] WHEN content = '' THEN [] ELSE string_split(content, chr(10)) END AS parts FROM files)),
  marked AS (SELECT *, trim(text, ' ' || chr(9) || chr(13)) = '' AS blank FROM shown)"""


@query(
    "view_line_table",
    f"""{SHOWN} SELECT path, line, CASE WHEN NOT blank THEN sum(CASE WHEN blank THEN 0 ELSE 1 END) OVER (PARTITION BY path ORDER BY line) END::BIGINT AS nonblank, text FROM marked""",
)
def _(spark, sf):
    return V.line_table(files(spark, sf)).select("path", "line", F.col("nonblank").cast("bigint").alias("nonblank"), "text")


@query(
    "view_squeeze",
    f"""{SHOWN} SELECT path, coalesce(string_agg(text, chr(10) ORDER BY line) FILTER (NOT (blank AND before)), '') AS content
        FROM (SELECT *, coalesce(lag(blank) OVER (PARTITION BY path ORDER BY line), false) AS before FROM marked) GROUP BY path""",
)
def _(spark, sf):
    return V.squeeze_blank_lines(files(spark, sf))
