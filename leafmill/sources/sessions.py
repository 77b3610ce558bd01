"""Question sets over conversations: two public JSON shapes, read as documents,
questions and evidence.  Everything happens inside the row of one conversation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X

# The schemas and names of the two question sets.
DIALOG_SCHEMA = (
    "sample_id string, conversation map<string,string>, "
    "qa array<struct<question:string,answer:string,evidence:array<string>,category:int>>"
)
TURNS_SCHEMA = "array<struct<speaker:string,dia_id:string,text:string,blip_caption:string>>"
CATEGORIES = {1: "1-multi-hop", 2: "2-temporal", 3: "3-open-domain", 4: "4-single-hop"}
UNANSWERABLE_CATEGORY = 5
HISTORY_SCHEMA = (
    "question_id string, question_type string, question string, answer string, "
    "question_date string, haystack_dates array<string>, "
    "haystack_sessions array<array<struct<role:string,content:string,has_answer:boolean>>>"
)
SHORT_TEXT, LONG_TEXT = 40, 80


def read_dialogs(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """One row per sample of a JSON array (or of JSON lines)."""
    return spark.read.schema(DIALOG_SCHEMA).option("multiLine", multi_line).json(path)


def read_histories(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    return spark.read.schema(HISTORY_SCHEMA).option("multiLine", multi_line).json(path)


def _json_text(text: Column) -> Column:
    """A text as a JSON string literal."""
    return F.regexp_replace(F.to_json(F.array(text)), r"\A\[|\]\z", "")


def session_header(title: Column, date: Column) -> Column:
    return F.concat(
        F.lit("---\ntitle: "), _json_text(title), F.lit("\ndate: "), _json_text(date),
        F.lit("\ntags: [conversation]\n---\n\n"),
    )


# --- dialogs between two speakers -------------------------------------------------


def dialog_sessions(samples: DataFrame) -> DataFrame:
    """(sample_id, speakers, session, date, turns) of the sessions that have turns."""
    entry = samples.select("sample_id", "conversation", F.explode("conversation").alias("key", "value"))
    number = F.regexp_extract("key", r"\Asession_(\d+)\z", 1)
    return (
        entry.filter(number != "")
        .select(
            "sample_id",
            F.concat(
                F.coalesce(F.col("conversation")["speaker_a"], F.lit("")), F.lit(" and "),
                F.coalesce(F.col("conversation")["speaker_b"], F.lit("")),
            ).alias("speakers"),
            number.cast("int").alias("session"),
            F.coalesce(F.try_element_at("conversation", F.concat("key", F.lit("_date_time"))), F.lit("")).alias("date"),
            F.from_json("value", TURNS_SCHEMA).alias("turns"),
        )
        .filter(F.size("turns") > 0)
    )


def dialog_path(sample: Column, session: Column) -> Column:
    return F.format_string("/conversations/%s/session-%02d.md", sample, session)


def dialog_documents(samples: DataFrame) -> DataFrame:
    """(path, content): one Markdown document per session."""
    line = F.transform(
        "turns",
        lambda t: F.concat(
            F.lit("["), t.speaker, F.lit("] ("), t.dia_id, F.lit("): "), t.text,
            F.when(
                F.coalesce(t.blip_caption, F.lit("")) != "",
                F.concat(F.lit(" (shared image: "), t.blip_caption, F.lit(")")),
            ).otherwise(F.lit("")),
            F.lit("\n\n"),
        ),
    )
    title = F.concat("speakers", F.lit(", session "), F.col("session").cast("string"))
    return dialog_sessions(samples).select(
        dialog_path(F.col("sample_id"), F.col("session")).alias("path"),
        F.concat(
            session_header(title, F.col("date")),
            F.lit("# Conversation between "), "speakers", F.lit("\n\nDate: "), "date", F.lit("\n\n"),
            F.array_join(line, ""),
        ).alias("content"),
    )


def dialog_questions(samples: DataFrame) -> DataFrame:
    """(question_id, scope, group, question, gold, date, turns, docs) of a dialog set.

    An evidence entry names turns as D<session>:<turn>; several can share an entry, and
    turns that the conversation does not have are ignored.
    """
    keys = F.filter(
        F.map_keys("conversation"), lambda k: k.rlike(r"\Asession_\d+\z")
    )
    sessions = F.transform(
        keys,
        lambda k: F.struct(
            F.regexp_extract(k, r"(\d+)", 1).cast("int").alias("session"),
            F.coalesce(F.try_element_at("conversation", F.concat(k, F.lit("_date_time"))), F.lit("")).alias("date"),
            F.transform(
                F.from_json(F.element_at("conversation", k), TURNS_SCHEMA), lambda t: t.dia_id
            ).alias("ids"),
        ),
    )
    rows = samples.select(
        "sample_id", "qa", F.filter(sessions, lambda s: F.size(s.ids) > 0).alias("sessions")
    )
    rows = rows.select(
        "sample_id",
        "sessions",
        F.coalesce(F.array_max("sessions").date, F.lit("")).alias("date"),
        F.posexplode("qa").alias("number", "qa"),
    ).filter(F.coalesce(F.col("qa.category"), F.lit(0)) != UNANSWERABLE_CATEGORY)
    named = F.flatten(
        F.transform("qa.evidence", lambda e: F.regexp_extract_all(e, F.lit(r"(D:?\d+:\d+)"), F.lit(1)))
    )
    parsed = F.array_distinct(
        F.transform(
            named,
            lambda m: F.struct(
                F.regexp_extract(m, r"D:?(\d+):", 1).cast("int").alias("session"),
                F.regexp_extract(m, r"(\d+)\z", 1).alias("turn"),
            ),
        )
    )
    known = F.filter(
        parsed,
        lambda m: F.exists(
            "sessions",
            lambda s: (s.session == m.session)
            & F.array_contains(s.ids, F.format_string("D%d:%s", m.session, m.turn)),
        ),
    )
    group = F.element_at(F.create_map(*[F.lit(v) for kv in CATEGORIES.items() for v in kv]), F.col("qa.category"))
    none = F.array().cast("array<struct<session:int,turn:string>>")
    return rows.withColumn("known", F.coalesce(known, none)).select(
        F.format_string("%s:%d", "sample_id", "number").alias("question_id"),
        F.col("sample_id").alias("scope"),
        F.coalesce(group, F.lit("")).alias("group"),
        F.col("qa.question").alias("question"),
        F.col("qa.answer").alias("gold"),
        "date",
        F.transform("known", lambda m: F.array(F.format_string("(D%d:%s)", m.session, m.turn))).alias("turns"),
        F.array_sort(
            F.array_distinct(F.transform("known", lambda m: dialog_path(F.col("sample_id"), m.session)))
        ).alias("docs"),
    )


# --- chat histories ---------------------------------------------------------------


def _clean(text: Column) -> Column:
    return F.replace(F.coalesce(text, F.lit("")), F.char(F.lit(0)), F.lit(""))


def _ordered_sessions(histories: DataFrame) -> DataFrame:
    """Sessions of each history as an array in time order; equal dates keep their order.

    The document names follow this order, because the identifiers of the sessions would
    give away which of them hold the answer.
    """
    zipped = F.transform(
        F.arrays_zip("haystack_dates", "haystack_sessions"),
        lambda s, i: F.struct(s.haystack_dates.alias("date"), i.alias("pos"), s.haystack_sessions.alias("turns")),
    )
    return histories.withColumn(
        "agrees", F.size("haystack_dates") == F.size("haystack_sessions")
    ).withColumn("sessions", F.array_sort(zipped, lambda a, b: (
        F.when(a.date < b.date, -1).when(a.date > b.date, 1).when(a.pos < b.pos, -1).otherwise(1)
    )))


def history_path(scope: Column, position: Column) -> Column:
    return F.format_string("/conversations/%s/session-%03d.md", scope, position + 1)


def history_documents(histories: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(documents, rejected): one document per session; histories whose dates do not fit
    their sessions are rejected."""
    rows = _ordered_sessions(histories)
    lines = F.transform(
        "session.turns", lambda t: F.concat(F.lit("["), t.role, F.lit("]: "), _clean(t.content), F.lit("\n\n"))
    )
    title = F.concat(F.lit("Chat session on "), F.col("session.date"))
    documents = (
        rows.filter("agrees")
        .select("question_id", F.posexplode("sessions").alias("position", "session"))
        .select(
            history_path(F.col("question_id"), F.col("position")).alias("path"),
            F.concat(
                session_header(title, F.col("session.date")), F.lit("# "), title, F.lit("\n\n"),
                F.array_join(lines, ""),
            ).alias("content"),
        )
    )
    return documents, rows.filter("not agrees").select("question_id", F.lit("DATES_DIFFER").alias("reject_reason"))


def turn_texts(role: Column, content: Column) -> Column:
    """Texts that show a turn in a result: its start as the document has it, and the start
    of each long line.  Short texts can occur in other turns too and do not count."""
    lines = F.split(_clean(content), "\n")
    head = F.get(lines, F.lit(0))
    first = F.when(
        F.octet_length(X.trim(head)) >= SHORT_TEXT,
        F.array(X.cut_bytes(F.concat(F.lit("["), role, F.lit("]: "), head), LONG_TEXT)),
    ).otherwise(F.array().cast("array<string>"))
    rest = F.transform(
        F.filter(F.transform(lines, X.trim), lambda line: F.octet_length(line) >= SHORT_TEXT),
        lambda line: X.cut_bytes(line, LONG_TEXT),
    )
    return F.concat(first, rest)


def history_questions(histories: DataFrame) -> DataFrame:
    """Questions with the evidence turns and documents of their own history.

    A question that must be refused (``_abs``) has no evidence.
    """
    answered = F.transform(
        "sessions",
        lambda s, i: F.struct(
            history_path(F.col("question_id"), i).alias("doc"),
            F.filter(
                F.transform(
                    F.filter(s.turns, lambda t: F.coalesce(t.has_answer, F.lit(False))),
                    lambda t: turn_texts(t.role, t.content),
                ),
                lambda texts: F.size(texts) > 0,
            ).alias("texts"),
        ),
    )
    rows = _ordered_sessions(histories).withColumn("answered", answered)
    has_evidence = F.col("agrees") & ~F.endswith("question_id", F.lit("_abs"))
    return rows.select(
        "question_id",
        F.col("question_id").alias("scope"),
        F.col("question_type").alias("group"),
        "question",
        F.col("answer").alias("gold"),
        F.col("question_date").alias("date"),
        F.when(has_evidence, F.flatten(F.transform("answered", lambda a: a.texts)))
        .otherwise(F.array().cast("array<array<string>>")).alias("turns"),
        F.when(has_evidence, F.transform(F.filter("answered", lambda a: F.size(a.texts) > 0), lambda a: a.doc))
        .otherwise(F.array().cast("array<string>")).alias("docs"),
    )
