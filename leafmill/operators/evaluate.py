"""Retrieval statistics over question sets, search hits and tool traces."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import broadcast_if_small, durable
from .pattern_table import documents_holding
from .search import holding_counter

# The line forms of printed search results, and the events of a trace.
RESULT_LINE = r"(?dm)^(/\S+)    \[rank: "
RESULT_BLOCK = r"(?dm)(?:^/\S+    \[rank: .*\n|\G(?!\A)(  > .*\n)|\G(?!\A)  .*\n)"
SUMMARY_LINE = (
    r"(?dm)^(?:  abstract: .*|  \(\d+\+? more lines match; \S+ cat .* shows the document\)"
    r"|directories:|  /\S*/(?:    .*)?)\n"
)
NO_RESULTS = r"(?dm)^no results found$"
TOOL_EVENTS = ("tool_execution_start", "tool_execution_end")


# --- selection of questions -------------------------------------------------------


def with_position(rows: DataFrame, *order: str) -> DataFrame:
    """Rows with their global position in an order, without a single-task window.

    The sorted rows are written once with a per-task number; the offsets of the tasks are
    a small table.
    """
    numbered = durable(rows.orderBy(*order).withColumn("_n", F.monotonically_increasing_id()), "sorted")
    task = F.shiftrightunsigned("_n", 33)
    counts = numbered.groupBy(task.alias("_task")).agg(F.count(F.lit(1)).alias("_rows"))
    before = Window.orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_task", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_offset"))
    return (
        numbered.withColumn("_task", task)
        .join(F.broadcast(offsets), "_task")
        .withColumn("position", F.col("_offset") + F.col("_n").bitwiseAND(F.lit((1 << 33) - 1)))
        .drop("_n", "_task", "_offset")
    )


def equal_intervals(rows: DataFrame, count: int, *order: str) -> DataFrame:
    """``count`` rows at equal intervals of an order; all rows when there are not more."""
    length = rows.count()
    if count <= 0 or count >= length:
        return rows
    placed = with_position(rows, *order)
    p, n, size = F.col("position"), F.lit(count), F.lit(length)
    step = F.floor((p * n + size - 1) / size)
    return placed.filter((step < n) & (F.floor(step * size / n) == p)).drop("position")


def select_questions(
    questions: DataFrame, scopes: Iterable[str] = (), groups: Iterable[str] = (), count: int = 0,
    order: tuple[str, ...] = ("question_id",),
) -> DataFrame:
    scopes, groups = list(scopes), list(groups)
    if scopes:
        questions = questions.filter(F.col("scope").isin(scopes))
    if groups:
        questions = questions.filter(F.col("group").isin(groups))
    return equal_intervals(questions, count, *order)


def unanswered(questions: DataFrame, records: DataFrame) -> DataFrame:
    """Questions without an answer, or whose answer failed."""
    good = records.filter(F.coalesce("error", F.lit("")) == "").select(F.col("id").alias("question_id"))
    return questions.join(good, "question_id", "left_anti")


def ungraded(answers: DataFrame, grades: DataFrame) -> DataFrame:
    """Good answers without a good grade of the same text; a new answer voids an old grade."""
    good = grades.filter(F.coalesce("error", F.lit("")) == "").select("id", "response")
    return answers.filter(F.coalesce("error", F.lit("")) == "").join(good, ["id", "response"], "left_anti")


# --- traces -----------------------------------------------------------------------

_EVENT = "type string, message struct<role:string>"
_RESULT = "type string, result struct<content:array<struct<text:string>>>"
_MESSAGE = (
    "type string, message struct<role:string,stopReason:string,errorMessage:string,"
    "usage:struct<input:bigint,output:bigint,cacheRead:bigint>,content:string>"
)
_BLOCKS = "array<struct<type:string,text:string,name:string,arguments:struct<command:string>>>"


def compact_trace(lines: DataFrame) -> DataFrame:
    """Event lines (question_id, pos, line) that the statistics use."""
    event = F.from_json("line", _EVENT)
    assistant = (event["type"] == "message_end") & (event["message"]["role"] == "assistant")
    return lines.filter(F.coalesce(event["type"].isin(*TOOL_EVENTS) | assistant, F.lit(False)))


def trace_results(lines: DataFrame) -> DataFrame:
    """(question_id, pos, text): the text of each tool result."""
    event = F.from_json("line", _RESULT)
    texts = F.transform(event["result"]["content"], lambda block: F.coalesce(block.text, F.lit("")))
    return lines.filter(event["type"] == "tool_execution_end").select(
        "question_id", "pos", F.coalesce(F.array_join(texts, ""), F.lit("")).alias("text")
    )


def event_totals(lines: DataFrame, command: str) -> DataFrame:
    """Per question: tokens, tool calls, calls whose shell command fits an expression, and
    the text and stop reason of the last assistant message."""
    event = F.from_json("line", _MESSAGE)
    rows = (
        lines.select("question_id", "pos", event.alias("e"))
        .filter("e.type = 'message_end' and e.message.role = 'assistant'")
        .select("question_id", "pos", "e.message.*")
        .withColumn("blocks", F.coalesce(F.from_json("content", _BLOCKS), F.array().cast(_BLOCKS)))
    )
    calls = F.filter("blocks", lambda b: b.type == "toolCall")
    matching = F.filter(calls, lambda b: (b["name"] == "bash") & b.arguments.command.rlike(command))
    texts = F.transform(F.filter("blocks", lambda b: b.type == "text"), lambda b: b.text)
    last = F.max_by(
        F.struct(
            F.regexp_replace(F.array_join(texts, "\n"), r"\A\s+|\s+\z", "").alias("text"),
            F.coalesce("stopReason", F.lit("")).alias("stop"),
            F.coalesce("errorMessage", F.lit("")).alias("error"),
        ),
        F.col("pos"),
    )
    total = lambda name: F.sum(F.coalesce(F.col(f"usage.{name}"), F.lit(0)))
    return (
        rows.groupBy("question_id")
        .agg(
            total("input").alias("input_tokens"),
            total("output").alias("output_tokens"),
            total("cacheRead").alias("cache_read_tokens"),
            F.sum(F.size(calls)).alias("tool_calls"),
            F.sum(F.size(matching)).alias("tree_calls"),
            last.alias("last"),
        )
        .select("question_id", "input_tokens", "output_tokens", "cache_read_tokens", "tool_calls", "tree_calls", "last.*")
    )


def shown_content(text: Column | str) -> Column:
    """What a result shows of documents: of a search block only the passages; lines of
    summaries and directories never."""
    return F.regexp_replace(F.regexp_replace(text, RESULT_BLOCK, "$1"), SUMMARY_LINE, "")


def measure(results: DataFrame, evidence: DataFrame) -> DataFrame:
    """Per question: evidence turns seen, documents listed, searches, empty and repeated.

    ``results`` is (question_id, pos, text); ``evidence`` is (question_id, turns, docs) with
    one row per question, so each result meets its evidence once.
    """
    listed = F.regexp_extract_all("text", F.lit(RESULT_LINE), F.lit(1))
    rows = results.withColumn("listed", listed).withColumn(
        "is_search", (F.size("listed") > 0) | F.col("text").rlike(NO_RESULTS)
    )
    by_order = Window.partitionBy("question_id", "is_search").orderBy("pos")
    rows = rows.withColumn(
        "repeated", F.col("is_search") & F.coalesce(F.lag(F.size("listed") == 0).over(by_order), F.lit(False))
    )
    content = F.col("content")
    seen = F.filter(
        F.transform(
            F.coalesce("turns", F.array().cast("array<array<string>>")),
            lambda texts, i: F.when(F.exists(texts, lambda t: F.contains(content, t)), i),
        ),
        lambda i: i.isNotNull(),
    )
    found = F.array_intersect(
        F.when(F.col("is_search"), F.col("listed")).otherwise(F.array().cast("array<string>")),
        F.coalesce("docs", F.array().cast("array<string>")),
    )
    return (
        rows.withColumn("content", shown_content("text"))
        .join(evidence.select("question_id", "turns", "docs"), "question_id", "left")
        .select("question_id", "is_search", "listed", "repeated", seen.alias("seen"), found.alias("found"))
        .groupBy("question_id")
        .agg(
            F.size(F.array_distinct(F.flatten(F.collect_set("seen")))).alias("seen"),
            F.size(F.array_distinct(F.flatten(F.collect_set("found")))).alias("listed"),
            F.count_if("is_search").alias("searches"),
            F.count_if(F.col("is_search") & (F.size("listed") == 0)).alias("empty"),
            F.count_if("repeated").alias("repeated"),
        )
    )


def _ratio(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole)


def totals(measures: DataFrame, evidence: DataFrame, grades: DataFrame) -> DataFrame:
    """One row of counts and ratios; a ratio of nothing is null.

    ``grades`` is (question_id, correct).
    """
    rows = measures.join(grades, "question_id").join(
        evidence.select(
            "question_id", F.size("turns").alias("n_turns"), F.size("docs").alias("n_docs")
        ),
        "question_id",
        "left",
    ).fillna(0, ["n_turns", "n_docs"])
    known = F.col("n_turns") > 0
    all_seen = known & (F.col("seen") == F.col("n_turns"))
    sums = rows.agg(
        F.count(F.lit(1)).alias("questions"),
        F.count_if(known).alias("with_evidence"),
        F.count_if(F.col("empty") > 0).alias("with_empty"),
        F.sum(F.when(known, F.col("seen")).otherwise(0)).alias("turns_seen"),
        F.sum("n_turns").alias("turns"),
        F.sum(F.when(known, F.col("listed")).otherwise(0)).alias("docs_listed"),
        F.sum(F.when(known, F.col("n_docs")).otherwise(0)).alias("docs"),
        F.count_if(all_seen).alias("all_seen"),
        F.count_if(all_seen & F.col("correct")).alias("all_seen_correct"),
        F.count_if(known & ~all_seen & F.col("correct")).alias("not_seen_correct"),
        F.sum("searches").alias("searches"),
        F.sum("empty").alias("empty"),
        F.sum("repeated").alias("repeated"),
    )
    c = F.col
    return sums.select(
        "*",
        _ratio(c("turns_seen"), c("turns")).alias("turns_seen_ratio"),
        _ratio(c("all_seen"), c("with_evidence")).alias("all_seen_ratio"),
        _ratio(c("all_seen_correct"), c("all_seen")).alias("accuracy_seen"),
        _ratio(c("not_seen_correct"), c("with_evidence") - c("all_seen")).alias("accuracy_not_seen"),
        _ratio(c("docs_listed"), c("docs")).alias("docs_listed_ratio"),
        _ratio(c("searches"), c("questions")).alias("searches_per_question"),
        _ratio(c("empty"), c("searches")).alias("empty_ratio"),
        _ratio(c("repeated"), c("searches")).alias("repeated_ratio"),
        _ratio(c("with_empty"), c("questions")).alias("with_empty_ratio"),
    )


def accuracy(records: DataFrame) -> DataFrame:
    """Accuracy and average cost per group and over all (``group`` null, ``overall`` true)."""
    graded = records.filter("correct is not null")
    mean = lambda name: F.avg(F.coalesce(F.col(name), F.lit(0)))
    return (
        graded.rollup("group")
        .agg(
            F.grouping("group").cast("boolean").alias("overall"),
            F.count_if("correct").alias("correct"),
            F.count(F.lit(1)).alias("total"),
            (F.count_if("correct") / F.count(F.lit(1))).alias("accuracy"),
            mean("input_tokens").alias("input_tokens"),
            mean("output_tokens").alias("output_tokens"),
            mean("cache_read_tokens").alias("cache_read_tokens"),
            mean("tool_calls").alias("tool_calls"),
            mean("tree_calls").alias("tree_calls"),
            mean("seconds").alias("seconds"),
        )
    )


def failed_count(answers: DataFrame, grades: DataFrame) -> DataFrame:
    """Answers with an error plus records without a grade."""
    bad = answers.filter(F.coalesce("error", F.lit("")) != "").select("id").unionAll(
        grades.filter("correct is null").select("id")
    )
    return bad.agg(F.count(F.lit(1)).alias("failed"))


def recall_at_k(hits: DataFrame, evidence: DataFrame, ks: tuple[int, ...] = (1, 3, 10)) -> DataFrame:
    """(k, questions, hit, recall): questions with an evidence document among the first k.

    ``hits`` is (query_id, path, place), ``evidence`` is (query_id, path).
    """
    best = hits.join(evidence, ["query_id", "path"]).groupBy("query_id").agg(F.min("place").alias("best"))
    rows = evidence.select("query_id").distinct().join(best, "query_id", "left")
    sums = rows.agg(
        F.count(F.lit(1)).alias("questions"), *[F.count_if(F.col("best") <= k).alias(f"k{k}") for k in ks]
    )
    return sums.select(
        "questions",
        F.inline(F.array(*[F.struct(F.lit(k).alias("k"), F.col(f"k{k}").alias("hit")) for k in ks])),
    ).select("k", "questions", "hit", _ratio(F.col("hit"), F.col("questions")).alias("recall"))


# --- exact containment of passages ------------------------------------------------

_WORD = r"[\p{L}\p{Nd}]+"
_INNER = r"(?<=[^\p{L}\p{Nd}])[\p{L}\p{Nd}]+(?=[^\p{L}\p{Nd}])"
ANCHOR_WORDS = 4
# Texts, and bytes of them, that every task gets.
MOST_TEXTS, MOST_TEXT_BYTES = 200_000, 4 << 20


def _word_runs(words: Column, length: int) -> Column:
    """Distinct runs of consecutive words, joined by a blank."""
    return F.when(
        F.size(words) >= length,
        F.array_distinct(
            F.transform(
                F.sequence(F.lit(1), F.greatest(F.size(words) - (length - 1), F.lit(1))),
                lambda i: F.array_join(F.slice(words, i, F.lit(length)), " "),
            )
        ),
    ).otherwise(F.array().cast("array<string>"))


def _held_in_place(files: DataFrame, needles: DataFrame) -> DataFrame | None:
    """The result of :func:`containing_documents` from a walk over the bytes of each document; None if a task cannot hold the texts."""
    rows = needles.filter("needle is not null").select("needle_id", "needle")
    size = F.octet_length("needle")
    total = rows.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(size), F.lit(0)).alias("size"), F.min(size).alias("least")).first()
    if not total.least or total.n > MOST_TEXTS or total.size > MOST_TEXT_BYTES:
        return None
    texts = [r.needle for r in rows.select("needle").distinct().collect()]
    if (counter := holding_counter(texts)) is None:
        return None
    named = rows.sparkSession.createDataFrame(list(enumerate(texts)), "number int, needle string")
    named = broadcast_if_small(rows.join(named, "needle").select("needle_id", "number"))
    held = files.filter("content is not null").select("path", F.col("content").alias("text")).mapInArrow(counter, "path string, numbers array<int>")
    return held.select("path", F.explode("numbers").alias("number")).join(named, "number").select("needle_id", "path")


def containing_documents(files: DataFrame, needles: DataFrame) -> DataFrame:
    """(needle_id, path): documents that contain each text exactly.

    Few texts are looked for where the documents are, which are not moved.  More, empty or very long ones meet them by
    keys: words inside a text (with a separator on both sides) are whole words of every document
    that contains it.  A run of such words is the join key, so texts and documents never
    form a product; the full text is then compared.  Texts with fewer inner words than a run
    use shorter runs.  Texts without inner words meet the documents by their rarest character n-gram.
    """
    if (found := _held_in_place(files, needles)) is not None:
        return found
    inner = F.regexp_extract_all("needle", F.lit(_INNER), F.lit(0))
    keyed = (
        needles.select("needle_id", "needle", inner.alias("words"))
        .withColumn("length", F.least(F.size("words"), F.lit(ANCHOR_WORDS)))
        .withColumn("start", F.floor((F.size("words") - F.col("length")) / 2).cast("int") + 1)
        .withColumn("anchor", F.array_join(F.slice("words", F.col("start"), F.col("length")), " "))
    )
    lengths = [r[0] for r in keyed.select("length").distinct().limit(ANCHOR_WORDS + 1).collect()]
    wordless = None
    if 0 in lengths:
        lengths.remove(0)
        others = keyed.filter("length = 0").select("needle_id", "needle")
        held = documents_holding(files, others)
        wordless = held.join(broadcast_if_small(others), "needle").select("needle_id", "path")
        keyed = keyed.filter("length > 0")
        if not lengths:
            return wordless
    words = files.select(
        "path", "content", F.regexp_extract_all("content", F.lit(_WORD), F.lit(0)).alias("words")
    )
    runs = F.concat(*[_word_runs(F.col("words"), n) for n in sorted(lengths)]) if lengths else F.array().cast("array<string>")
    anchors = broadcast_if_small(keyed.select("anchor").distinct())
    candidates = words.select("path", F.explode(runs).alias("anchor")).join(anchors, "anchor", "left_semi")
    pairs = candidates.join(broadcast_if_small(keyed.select("needle_id", "needle", "anchor")), "anchor").select(
        "path", "needle_id", "needle"
    )
    found = (
        files.select("path", "content")
        .join(pairs, "path")
        .filter(F.contains("content", F.col("needle")))
        .select("needle_id", "path")
    )
    return found if wordless is None else found.unionByName(wordless)


# --- printed results as traces ----------------------------------------------------


def printed_results(hits: DataFrame, tool: str = "leafmill") -> DataFrame:
    """(query_id, text): the page of each query as a search tool prints it.

    A page has at most a hundred documents.
    """
    more = F.when(
        (F.col("more_lines") > 0) | F.col("more_lines_min"),
        F.concat(
            F.lit("  ("), F.col("more_lines").cast("string"), F.when(F.col("more_lines_min"), F.lit("+")).otherwise(F.lit("")),
            F.lit(f" more lines match; {tool} cat "), "path", F.lit(" shows the document)\n"),
        ),
    ).otherwise(F.lit(""))
    block = F.concat(
        "path", F.format_string("    [rank: %.2f, %d bytes]\n", "rank", "size"),
        F.when(F.col("abstract") != "", F.concat(F.lit("  abstract: "), F.translate("abstract", "\n", " "), F.lit("\n"))).otherwise(F.lit("")),
        F.array_join(F.transform("passages", lambda p: F.concat(F.lit("  > "), p, F.lit("\n"))), ""),
        more, F.lit("\n"),
    )
    return hits.groupBy("query_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", block.alias("block")))), lambda b: b.block), "").alias("text")
    )
