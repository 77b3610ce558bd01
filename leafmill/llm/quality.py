"""Quality rules with the cross-document frequency of lines.

Base rules look at one document.  The method looks across documents: every line is normalised (lower
case, runs of white space as one space) and hashed; the distinct documents of each host that
hold it are counted, equal texts as one document.  A line above the limit, a number of documents that does not
depend on the host's size, is removed from every document of the host but the first (smallest ``doc_id``), so that nothing
vanishes from the corpus.  A document is depleted,
and rejected, when fewer than ``left`` percent of its words remain.  :func:`quality` gives the figures,
:func:`cleaned` the documents that are kept, without the removed lines.

Defined results: null is the empty text (0 words, fails the base rules); a null host is a host of its own; rows
without ``doc_id`` count, and come last for "first"; repeated rows are judged row by row and count once.
Other columns are not looked at.
"""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import broadcast_if_small, durable
from .common import query, table

WORD = r"[^\x20\x09-\x0D]+"
MIN_WORDS = 50
REPEATED_PERCENT = 50
#: A line is removed above this number of documents of the host, whatever the host's size.
LIMIT_DOCUMENTS = 20
#: A further limit in percent of the host's documents, for callers who want one.
LIMIT_PERCENT = 0
#: Percent of its words that a document has to keep.
LEFT_PERCENT = 20


def repeated_words(rows: DataFrame) -> DataFrame:
    """Add n_repeat_words to rows with an array ``words``: words in windows of three that occur twice or more.

    Windows are hashed; only where two are equal are they sorted with their places, and the
    places of equal neighbours are united.
    """
    windows = F.transform(
        F.sequence(F.lit(0), F.size("words") - 3),
        lambda i: F.xxhash64(F.get("words", i), F.get("words", i + 1), F.get("words", i + 2)),
    )
    rows = rows.withColumn("_windows", F.when(F.size("words") > 3, windows))
    rows = rows.withColumn(
        "_sorted",
        F.when(
            F.size(F.array_distinct("_windows")) < F.size("_windows"),
            F.sort_array(F.transform("_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i")))),
        ),
    )
    twice = F.filter(
        "_sorted",
        lambda x, j: (x["h"] == F.get("_sorted", j + 1)["h"]) | (x["h"] == F.get("_sorted", j - 1)["h"]),
    )
    rows = rows.withColumn("_places", F.sort_array(F.transform(twice, lambda x: x["i"])))
    new = F.zip_with(
        "_places",
        F.slice("_places", 2, F.greatest(F.size("_places"), F.lit(1))),
        lambda a, b: F.coalesce(F.least(F.lit(3), b - a), F.lit(3)),
    )
    covered = F.aggregate(new, F.lit(0).cast("long"), lambda total, n: total + n)
    return rows.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0).cast("long"))).drop("_windows", "_sorted", "_places")


def normalised(text: Column) -> Column:
    """The lines of a text in lower case, runs of white space as one space."""
    # F.trim itself would get the line's place as the signs to trim
    return F.transform(F.split(F.lower(F.regexp_replace(text, r"[\x20\x09\x0B-\x0D]+", " ")), "\n"), lambda line: F.trim(line))


def measured(documents: DataFrame) -> DataFrame:
    """One row per document: the base figures, and (hash, words) of its lines."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = documents.select(
        F.monotonically_increasing_id().alias("row"),
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit("")).alias("host"),
        text.alias("text"),
    )
    rows = rows.select(
        "row",
        "doc_id",
        "host",
        F.xxhash64("text").alias("same"),
        F.regexp_extract_all("text", F.lit(WORD), F.lit(0)).alias("words"),
        F.regexp_count("text", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        F.filter(F.split("text", "\n"), lambda line: line.rlike(WORD)).alias("raw"),
        F.filter(normalised(F.col("text")), lambda line: line != "").alias("spaced"),
    )
    rows = repeated_words(rows)
    lines = F.transform(
        "spaced",
        lambda line: F.struct(
            F.xxhash64(line).alias("line"),
            (F.length(line) - F.length(F.replace(line, F.lit(" "))) + 1).cast("long").alias("n"),
        ),
    )
    return rows.select(
        "row",
        "doc_id",
        "host",
        "same",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        "n_symbols",
        (F.size("raw") - F.size(F.array_distinct("raw"))).cast("long").alias("n_dup_lines"),
        "n_repeat_words",
        lines.alias("lines"),
    )


def frequent_lines(rows: DataFrame, limit_documents: int, limit_percent: float) -> DataFrame:
    """(host, line, first): the lines above the limits, with the first document that holds them."""
    held = rows.select("host", "same", "doc_id", F.explode(F.array_distinct("lines.line")).alias("line"))
    per_text = held.groupBy("host", "line", "same").agg(F.min("doc_id").alias("first"))
    counts = per_text.groupBy("host", "line").agg(F.count("*").alias("n_docs"), F.min("first").alias("first"))
    counts = counts.filter(F.col("n_docs") > limit_documents)
    if limit_percent:
        hosts = rows.groupBy("host", "same").agg(F.lit(1)).groupBy("host").agg(F.count("*").alias("n_host"))
        counts = counts.join(hosts, "host").filter(F.col("n_docs") * 100 > F.col("n_host") * limit_percent)
    return counts.select("host", "line", "first")


def judged(documents: DataFrame, limit_documents: int, limit_percent: float, left_percent: int) -> DataFrame:
    """The figures of every row, n_left, base_failed, kept, and ``gone``: the hashes of the lines it loses (or null)."""
    rows = durable(measured(documents), "measured")
    common = durable(frequent_lines(rows, limit_documents, limit_percent), "frequent")
    lines = rows.select("row", "doc_id", "host", F.explode("lines").alias("l")).select(
        "row", "doc_id", "host", F.col("l.line").alias("line"), F.col("l.n").alias("n")
    )
    removed = (
        lines.join(common, ["host", "line"])
        .filter(~F.col("doc_id").eqNullSafe(F.col("first")))
        .groupBy("row")
        .agg(F.sum("n").alias("removed"), F.collect_set("line").alias("gone"))
    )
    failed = base_failed(F.col("n_words"), F.col("n_repeat_words"))
    n_left = F.col("n_words") - F.coalesce("removed", F.lit(0))
    return rows.drop("lines").join(removed, "row", "left").withColumns(
        {"n_left": n_left, "base_failed": failed, "kept": ~failed & (n_left * 100 >= F.col("n_words") * left_percent)}
    )


def quality(
    documents: DataFrame,
    limit_documents: int = LIMIT_DOCUMENTS,
    limit_percent: float = LIMIT_PERCENT,
    left_percent: int = LEFT_PERCENT,
) -> DataFrame:
    """The figures of every document, base_failed, n_left (words that remain) and kept."""
    return judged(documents, limit_documents, limit_percent, left_percent).select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "n_left",
        "base_failed",
        "kept",
    )


def _kept(documents: DataFrame, clean: bool, *limits) -> DataFrame:
    slots = [f"_{i}" for i in range(len(documents.columns))]
    at = {c.lower(): s for c, s in zip(documents.columns, slots, strict=True)}
    named = documents.select(*[F.col(f"`{c}`").alias(s) for c, s in zip(documents.columns, slots, strict=True)])
    text = F.coalesce(F.col(at["text"]).cast("string"), F.lit(""))
    # what a verdict depends on; rows that agree in it have the same verdict, so no row needs a number
    ident, host = F.col(at["doc_id"]).cast("long"), F.coalesce(F.concat(F.lit("="), F.col(at["source"]).cast("string")), F.lit(""))
    verdicts = judged(documents, *limits).filter("not kept or gone is not null").groupBy("doc_id", "host", "same").agg(
        F.min("kept").alias("kept"), F.first("gone").alias("gone")
    )
    verdicts = broadcast_if_small(durable(verdicts if clean else verdicts.filter("not kept").drop("gone"), "verdicts"))
    met = ident.eqNullSafe(F.col("doc_id")) & (host == F.col("host")) & (F.xxhash64(text) == F.col("same"))
    rows = named.join(verdicts, met, "left").filter(F.coalesce("kept", F.lit(True)))
    values = {}
    if clean:
        lines = F.zip_with(
            F.split(text, "\n"), normalised(text), lambda raw, line: F.struct(raw.alias("raw"), F.xxhash64(line).alias("line"))
        )
        left = F.filter(lines, lambda x: ~F.array_contains("gone", x["line"]))
        rows = rows.withColumn(
            "_clean", F.when(F.col("gone").isNull(), F.col(at["text"])).otherwise(F.array_join(F.transform(left, lambda x: x["raw"]), "\n"))
        )
        values = {at["text"]: F.col("_clean")}
        if "n_chars" in at:
            kind = documents.schema.fields[list(at).index("n_chars")].dataType
            values[at["n_chars"]] = F.when(F.col("gone").isNull(), F.col(at["n_chars"])).otherwise(F.length("_clean").cast(kind))
    return rows.select(*[values.get(s, F.col(s)).alias(c) for c, s in zip(documents.columns, slots, strict=True)])


def keep_good(
    documents: DataFrame,
    limit_documents: int = LIMIT_DOCUMENTS,
    limit_percent: float = LIMIT_PERCENT,
    left_percent: int = LEFT_PERCENT,
) -> DataFrame:
    """The documents that are kept, all columns as they are; rows are judged one by one, also those without ``doc_id``."""
    return _kept(documents, False, limit_documents, limit_percent, left_percent)


def cleaned(
    documents: DataFrame,
    limit_documents: int = LIMIT_DOCUMENTS,
    limit_percent: float = LIMIT_PERCENT,
    left_percent: int = LEFT_PERCENT,
) -> DataFrame:
    """The documents that are kept, without the lines that their host repeats.

    The other columns stay; ``n_chars``, where there is one, is counted anew for the texts that change.
    """
    return _kept(documents, True, limit_documents, limit_percent, left_percent)


def without(documents: DataFrame, ids: DataFrame) -> DataFrame:
    """The documents whose id is not among ``ids``: texts are only shuffled where the ids are too many to broadcast."""
    names = {c.lower() for c in documents.columns}
    key = next(k for i in itertools.count() if (k := f"_gone{i}") not in names)
    gone = broadcast_if_small(ids.select(F.col("doc_id").cast("long").alias(key)))
    return documents.join(gone, F.col("doc_id").cast("long") == F.col(key), "left_anti")


def base_failed(n_words: Column, n_repeat_words: Column) -> Column:
    return (n_words < MIN_WORDS) | (n_repeat_words * 100 > n_words * REPEATED_PERCENT)


OP6_SQL = r"""
WITH texts AS (SELECT doc_id, source, coalesce(text, '') AS text, string_split(coalesce(text, ''), chr(10)) AS raw,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
words AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM texts),
windows AS (SELECT doc_id, i, word || ' ' || lead(word) OVER o || ' ' || lead(word, 2) OVER o AS win
            FROM words WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
twice AS (SELECT doc_id, win FROM windows WHERE win IS NOT NULL GROUP BY ALL HAVING count(*) > 1),
covered AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM windows JOIN twice USING (doc_id, win), (VALUES (0), (1), (2)) t(k)
            GROUP BY doc_id),
raw_lines AS (SELECT doc_id, source, unnest(raw) AS line FROM texts),
dups AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM raw_lines WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
plain AS (SELECT doc_id, source, trim(lower(regexp_replace(line, '[\x20\x09\x0B-\x0D]+', ' ', 'g')), ' ') AS line FROM raw_lines),
lines AS (SELECT doc_id, source, line, len(string_split(line, ' ')) AS n FROM plain WHERE line <> ''),
common AS (SELECT l.source, l.line, min(l.doc_id) AS first FROM lines l JOIN texts t ON t.doc_id = l.doc_id
           GROUP BY l.source, l.line HAVING count(DISTINCT t.text) > 20),
removed AS (SELECT l.doc_id, sum(l.n) AS n FROM lines l JOIN common c ON c.source = l.source AND c.line = l.line AND c.first <> l.doc_id
            GROUP BY l.doc_id),
figures AS (
  SELECT t.doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
         len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols, coalesce(d.n, 0)::BIGINT AS n_dup_lines,
         coalesce(c.n, 0)::BIGINT AS n_repeat_words, (len(w) - coalesce(r.n, 0))::BIGINT AS n_left
  FROM texts t LEFT JOIN covered c USING (doc_id) LEFT JOIN dups d USING (doc_id) LEFT JOIN removed r USING (doc_id))
SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND 100 * n_left >= 20 * n_words AS kept
FROM figures
"""


@query("op6_line_frequency", OP6_SQL)
def op6_line_frequency(spark, folder):
    return quality(table(spark, folder, "documents"))
