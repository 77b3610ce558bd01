"""Question sets, traces and retrieval statistics over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import evaluate as E
from ..session import durable
from ..sources import corpus as C
from ..sources import sessions as S
from .base import FILES, SEARCH, TERMS, TEXT_POSTINGS, benchmark_queries, files, query
from .browse import HISTORY, chat_histories, dialog_samples
from .retrieval import PAGE, full_search

# --- questions --------------------------------------------------------------------

NUMBERED = """numbered AS (SELECT conv_id, turn, text, turn // 500 + 1 AS s, row_number() OVER (PARTITION BY conv_id, turn // 500 ORDER BY turn) - 1 AS i FROM conversations)"""


@query(
    "question_dialogs",
    f"""WITH {NUMBERED} SELECT conv_id || ':' || i AS question_id, conv_id::VARCHAR AS scope,
        CASE i % 5 WHEN 0 THEN '1-multi-hop' WHEN 1 THEN '2-temporal' WHEN 2 THEN '3-open-domain' ELSE '4-single-hop' END AS "group",
        'What is turn ' || i || '?' AS question, text AS gold, 'day ' || s AS date,
        '(D' || s || ':' || (turn + 1) || ')' AS turns, printf('/conversations/%d/session-%02d.md', conv_id, s) AS docs FROM numbered WHERE i % 5 <> 4""",
)
def _(spark, sf):
    rows = S.dialog_questions(dialog_samples(spark, sf))
    return rows.select(
        "question_id", "scope", "group", "question", "gold", "date",
        F.array_join(F.flatten("turns"), ",").alias("turns"), F.array_join("docs", ",").alias("docs"),
    )


@query(
    "question_histories",
    rf"""WITH {HISTORY}, said AS (SELECT q, turn, n, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS k, role FROM turns WHERE turn % 2 = 1),
        texts AS (SELECT q, n, k, 1 AS part, '[' || role || ']: ' || line AS t FROM said WHERE k = 1 AND strlen(trim(line)) >= 40
                  UNION ALL SELECT q, n, k, 2, trim(line) FROM said WHERE strlen(trim(line)) >= 40),
        cut AS (SELECT *, left(t, list_max(list_filter(range(0, 81), lambda x: strlen(left(t, x)) <= 80))::INTEGER) AS c FROM texts),
        found AS (SELECT q, string_agg(c, '|' ORDER BY n, part, k) AS texts, count(*) AS text_count FROM cut GROUP BY q)
        SELECT a.q AS question_id, coalesce(texts, '') AS texts, coalesce(text_count, 0) AS text_count FROM (SELECT DISTINCT q FROM turns) a LEFT JOIN found f ON f.q = a.q""",
)
def _(spark, sf):
    rows = S.history_questions(chat_histories(spark, sf))
    return rows.select(
        "question_id", F.array_join(F.flatten("turns"), "|").alias("texts"), F.size(F.flatten("turns")).alias("text_count")
    )


@query(
    "question_selection",
    f"""WITH {NUMBERED}, chosen AS (SELECT conv_id || ':' || i AS question_id, row_number() OVER (ORDER BY conv_id || ':' || i) - 1 AS p, count(*) OVER () AS size FROM numbered WHERE i % 5 IN (0, 1))
        SELECT question_id FROM chosen WHERE p IN (SELECT (i * size) // 37 FROM chosen c2, range(37) t(i) WHERE c2.p = 0)""",
)
def _(spark, sf):
    questions = S.dialog_questions(dialog_samples(spark, sf))
    return E.select_questions(questions, groups=["1-multi-hop", "2-temporal"], count=37).select("question_id")


# --- records ----------------------------------------------------------------------


def label_records(spark, sf) -> DataFrame:
    """Grades of documents as answer records."""
    labels = C.read_table(spark, sf, "labels")
    documents = C.read_table(spark, sf, "documents").select("doc_id", "lang", "n_chars")
    return labels.join(documents, "doc_id").select(
        F.col("doc_id").cast("string").alias("id"),
        F.col("lang").alias("group"),
        F.concat(F.lit("r"), (F.col("doc_id") % 7).cast("string")).alias("response"),
        F.when(F.col("toxic") == 1, F.lit("timeout")).otherwise(F.lit("")).alias("error"),
        F.when(F.col("toxic") == 0, F.col("quality") == 1).alias("correct"),
        F.col("n_chars").alias("input_tokens"),
        (F.col("n_chars") % 100).alias("output_tokens"),
        F.lit(0).alias("cache_read_tokens"),
        (F.col("doc_id") % 4).alias("tool_calls"),
        (F.col("doc_id") % 2).alias("tree_calls"),
        (F.col("doc_id") % 10 / 2.0).alias("seconds"),
    )


RECORDS = """records AS (SELECT l.doc_id, lang AS grp, toxic, quality = 1 AS correct, n_chars FROM labels l JOIN documents d ON d.doc_id = l.doc_id)"""


@query(
    "record_accuracy",
    f"""WITH {RECORDS} SELECT grp AS "group", grp IS NULL AS overall, count(*) FILTER (correct) AS correct, count(*) AS total, round(count(*) FILTER (correct) / count(*), 9) AS accuracy,
        round(avg(n_chars), 6) AS input_tokens, round(avg(n_chars % 100), 6) AS output_tokens, round(avg(doc_id % 4), 6) AS tool_calls, round(avg(doc_id % 10 / 2.0), 6) AS seconds
        FROM records WHERE toxic = 0 GROUP BY ROLLUP (grp)""",
)
def _(spark, sf):
    rows = E.accuracy(label_records(spark, sf))
    return rows.select(
        "group", "overall", "correct", "total", F.round("accuracy", 9).alias("accuracy"),
        *[F.round(c, 6).alias(c) for c in ("input_tokens", "output_tokens", "tool_calls", "seconds")],
    )


@query("record_failures", f"WITH {RECORDS} SELECT 2 * count(*) FILTER (toxic = 1) AS failed FROM records")
def _(spark, sf):
    records = label_records(spark, sf)
    return E.failed_count(records, records)


@query(
    "record_ungraded",
    f"""WITH {RECORDS} SELECT doc_id::VARCHAR AS id FROM records WHERE toxic = 0 AND (doc_id % 7 >= 5 OR doc_id % 3 = 0)""",
)
def _(spark, sf):
    answers = label_records(spark, sf)
    n = F.col("id").cast("bigint")
    grades = answers.filter(n % 3 != 0).withColumn(
        "response", F.when(n % 7 >= 5, F.lit("an older answer")).otherwise(F.col("response"))
    )
    return E.ungraded(answers, grades).select("id")


@query("record_unanswered", f"WITH {RECORDS} SELECT doc_id::VARCHAR AS question_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM records WHERE toxic = 0)")
def _(spark, sf):
    questions = C.read_table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("question_id"))
    return E.unanswered(questions, label_records(spark, sf))


# --- traces -----------------------------------------------------------------------


def message_trace(spark, sf) -> DataFrame:
    """Conversations as event lines: assistant turns are messages, user turns tool calls."""
    turns = C.read_table(spark, sf, "conversations")
    assistant = F.to_json(
        F.struct(
            F.lit("message_end").alias("type"),
            F.struct(
                F.lit("assistant").alias("role"),
                F.when(F.col("turn") % 3 == 0, F.lit("stop")).otherwise(F.lit("toolUse")).alias("stopReason"),
                F.struct(F.length("text").alias("input"), F.col("turn").alias("output"), F.lit(1).alias("cacheRead")).alias("usage"),
                F.array(
                    F.struct(
                        F.lit("toolCall").alias("type"), F.lit("bash").alias("name"), F.lit(None).cast("string").alias("text"),
                        F.struct(F.concat(F.when(F.col("turn") % 4 == 1, F.lit("cd x; leafmill ")).otherwise(F.lit("ls my-leafmill ")), F.lit("search")).alias("command")).alias("arguments"),
                    ),
                    F.struct(
                        F.lit("text").alias("type"), F.lit(None).cast("string").alias("name"), F.concat(F.lit(" "), "role", F.lit(" "), F.col("turn").cast("string")).alias("text"),
                        F.lit(None).cast("struct<command:string>").alias("arguments"),
                    ),
                ).alias("content"),
            ).alias("message"),
        )
    )
    tool = F.to_json(
        F.struct(
            F.lit("tool_execution_end").alias("type"),
            F.struct(F.array(F.struct(F.col("text").alias("text")), F.struct(F.lit(" end").alias("text"))).alias("content")).alias("result"),
        )
    )
    other = F.lit('{"type":"message_update","message":{"role":"assistant"}}')
    return turns.select(
        F.col("conv_id").alias("question_id"),
        F.col("turn").alias("turn"),
        F.posexplode(F.array(other, F.when(F.col("role") == "assistant", assistant).otherwise(tool), F.lit("not JSON"))).alias("part", "line"),
    ).select("question_id", (F.col("turn") * 3 + F.col("part")).alias("pos"), "line")


@query("trace_compact", "SELECT conv_id AS question_id, turn * 3 + 1 AS pos FROM conversations")
def _(spark, sf):
    return E.compact_trace(message_trace(spark, sf)).select("question_id", "pos")


@query("trace_results", "SELECT conv_id AS question_id, turn * 3 + 1 AS pos, text || ' end' AS text FROM conversations WHERE role <> 'assistant'")
def _(spark, sf):
    return E.trace_results(message_trace(spark, sf))


@query(
    "trace_event_totals",
    """SELECT conv_id AS question_id, sum(length(text))::BIGINT AS input_tokens, sum(turn)::BIGINT AS output_tokens, count(*) AS cache_read_tokens, count(*) AS tool_calls,
       count(*) FILTER (turn % 4 = 1) AS tree_calls, 'assistant ' || max(turn) AS text, CASE WHEN max(turn) % 3 = 0 THEN 'stop' ELSE 'toolUse' END AS stop, '' AS error
       FROM conversations WHERE role = 'assistant' GROUP BY conv_id""",
)
def _(spark, sf):
    return E.event_totals(message_trace(spark, sf), r"(^|[^\p{Alnum}_/-])leafmill ")


def evidence_documents(spark, sf) -> DataFrame:
    """(query_id, path): the documents that contain a benchmark text."""
    needles = C.read_table(spark, sf, "benchmark").select(F.col("item_id").alias("needle_id"), F.col("text").alias("needle"))
    found = E.containing_documents(files(spark, sf), needles)
    return found.select(F.col("needle_id").alias("query_id"), "path")


@query("evidence_documents", f"WITH {FILES} SELECT item_id AS query_id, path FROM benchmark JOIN files ON contains(content, text)")
def _(spark, sf):
    return evidence_documents(spark, sf)


RECALL = f"""WITH {FILES}, {TERMS}, {TEXT_POSTINGS}, m AS (SELECT query_id, path, count(DISTINCT lexeme) AS matched, sum(tf) AS n FROM text_postings JOIN terms ON lexeme = term GROUP BY ALL),
    placed AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY matched DESC, n DESC, path) AS place FROM m),
    evidence AS (SELECT item_id AS query_id, path FROM benchmark JOIN files ON contains(content, text)),
    best AS (SELECT e.query_id, min(place) FILTER (place <= 10) AS best FROM evidence e LEFT JOIN placed p ON p.query_id = e.query_id AND p.path = e.path GROUP BY e.query_id)"""


@query(
    "evidence_recall",
    f"""{RECALL} SELECT k, count(*) AS questions, count(*) FILTER (best <= k) AS hit, round(count(*) FILTER (best <= k) / count(*), 9) AS recall FROM best, (SELECT unnest([1, 3, 10])::BIGINT AS k) GROUP BY k""",
)
def _(spark, sf):
    from ..operators import index as I
    from ..operators import search as R

    corpus = files(spark, sf)
    rows = durable(R.query_lexemes(benchmark_queries(spark, sf), "zh"), "queries")
    matched = R.page_matches(R.relevant(I.text_postings(corpus, "zh"), rows), corpus, rows)
    page = durable(R.top_page(R.found_documents(matched)), "page")
    evidence = durable(evidence_documents(spark, sf), "evidence")
    return E.recall_at_k(page, evidence).withColumn("recall", F.round("recall", 9))


def search_traces(spark, sf) -> tuple[DataFrame, DataFrame]:
    """(trace lines, evidence): the printed search page of each benchmark query as a tool
    result, after an empty result for every third query.

    The evidence turns of a query are the lines of its text; its evidence
    document is the first one (by path) that contains the whole text.
    """
    hits = durable(full_search(spark, sf).hits, "hits")
    printed = E.printed_results(hits).select(
        "query_id",
        F.posexplode(
            F.when(F.col("query_id") % 3 == 0, F.array(F.lit("no results found\n"), F.col("text"))).otherwise(F.array("text"))
        ).alias("pos", "text"),
    )
    event = F.to_json(
        F.struct(
            F.lit("tool_execution_end").alias("type"),
            F.struct(F.array(F.struct("text")).alias("content")).alias("result"),
        )
    )
    lines = printed.select(F.col("query_id").alias("question_id"), "pos", event.alias("line"))
    docs = evidence_documents(spark, sf).groupBy("query_id").agg(F.array(F.min("path")).alias("docs"))
    turns = F.transform(F.split("text", "\n"), lambda line: F.array(line))
    evidence = (
        C.read_table(spark, sf, "benchmark")
        .select(F.col("item_id").alias("query_id"), turns.alias("turns"))
        .join(docs, "query_id", "left")
        .select(
            F.col("query_id").alias("question_id"), "turns",
            F.coalesce("docs", F.array().cast("array<string>")).alias("docs"),
        )
    )
    return lines, durable(evidence, "evidence")


MEASURE = """evidence AS (SELECT item_id AS query_id, min(path) AS path FROM benchmark JOIN files ON contains(content, text) GROUP BY item_id),
  pages AS (SELECT p.query_id, count(*) AS listed, count(*) FILTER (p.path IN (SELECT path FROM evidence e WHERE e.query_id = p.query_id)) AS found FROM page p GROUP BY p.query_id)"""


@query(
    "trace_measure",
    f"""WITH {SEARCH}, {PAGE}, {MEASURE} SELECT query_id AS question_id, found AS listed, CASE WHEN query_id % 3 = 0 THEN 2 ELSE 1 END::BIGINT AS searches,
        CASE WHEN query_id % 3 = 0 THEN 1 ELSE 0 END::BIGINT AS "empty", CASE WHEN query_id % 3 = 0 THEN 1 ELSE 0 END::BIGINT AS repeated FROM pages""",
)
def _(spark, sf):
    lines, evidence = search_traces(spark, sf)
    rows = E.measure(E.trace_results(E.compact_trace(lines)), evidence)
    return rows.select("question_id", "listed", "searches", "empty", "repeated")


@query("trace_seen_turns")
def _(spark, sf):
    lines, evidence = search_traces(spark, sf)
    return E.measure(E.trace_results(lines), evidence).select("question_id", "seen")


@query("trace_totals")
def _(spark, sf):
    lines, evidence = search_traces(spark, sf)
    measures = E.measure(E.trace_results(lines), evidence)
    grades = evidence.select("question_id", (F.col("question_id") % 2 == 0).alias("correct"))
    return E.totals(measures, evidence, grades)
