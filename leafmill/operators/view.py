"""Document reads for tables of requests, and line views of a corpus."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import headers as H
from ..functions import paths as P
from ..functions import text as X
from ..session import pick


def cat(files: DataFrame, requests: DataFrame) -> DataFrame:
    """Content, hash, body and metadata of requested paths.

    Only the requested documents go through the header decoder.
    """
    wanted = requests.withColumn("path", P.clean("path"))
    found = pick(files.select("path", "content", "content_hash"), wanted)
    return wanted.join(H.parse_headers(found), "path", "left").withColumn(
        "status", F.when(F.col("content").isNull(), F.lit("NOT_FOUND")).otherwise(F.lit("OK"))
    )


def etag_matches(tags: Column | str, content_hash: Column | str) -> Column:
    """True when a comma-separated tag list names the hash, quoted or not, or is ``*``."""
    tags = F.col(tags) if isinstance(tags, str) else tags
    content_hash = F.col(content_hash) if isinstance(content_hash, str) else content_hash
    names = F.transform(
        F.split(tags, ","),
        lambda t: F.regexp_replace(F.regexp_replace(F.trim(t), "^W/", ""), '^"|"$', ""),
    )
    return F.coalesce(F.exists(names, lambda t: (t == "*") | (t == content_hash)), F.lit(False))


def changed(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """Rows of a manifest (path, if_none_match) whose document differs or is gone.

    Unchanged documents are not in the result.
    """
    known = manifest.select(P.clean("path").alias("path"), "if_none_match")
    current = files.select("path", "content_hash")
    return (
        known.join(current, "path", "left")
        .filter(
            F.col("content_hash").isNull() | ~etag_matches("if_none_match", "content_hash")
        )
        .select(
            "path",
            "content_hash",
            F.when(F.col("content_hash").isNull(), F.lit("NOT_FOUND"))
            .otherwise(F.lit("CHANGED"))
            .alias("status"),
        )
    )


def _shown_lines(content: Column | str, squeeze: bool) -> Column:
    """Lines without the empty one after the last newline; optionally squeezed."""
    every = X.lines(content)
    shown = F.when(
        F.endswith(F.col(content) if isinstance(content, str) else content, F.lit("\n")),
        F.slice(every, F.lit(1), F.size(every) - 1),
    ).otherwise(F.when(F.col("content") == "", F.array().cast("array<string>")).otherwise(every))
    return shown


def line_table(files: DataFrame, squeeze: bool = False) -> DataFrame:
    """(path, line, nonblank, text): every line with its number among all lines and, for
    lines that are not blank, among those.

    Both numberings come from arrays of the document itself, without a window.
    """
    rows = files.select("path", _shown_lines("content", squeeze).alias("lines"))
    if squeeze:
        rows = rows.select(
            "path",
            F.filter(
                "lines",
                lambda text, i: ~(
                    X.is_blank(text) & (i > 0) & X.is_blank(F.coalesce(F.get("lines", i - 1), F.lit("x")))
                ),
            ).alias("lines"),
        )
    numbered = rows.select(
        "path",
        F.transform(
            "lines",
            lambda text, i: F.struct((i + 1).alias("line"), text.alias("text"), X.is_blank(text).alias("blank")),
        ).alias("rows"),
    )
    full = F.transform(
        F.filter("rows", lambda r: ~r.blank),
        lambda r, i: F.struct(r.line.alias("line"), (i + 1).alias("nonblank"), r.text.alias("text")),
    )
    blank = F.transform(
        F.filter("rows", lambda r: r.blank),
        lambda r: F.struct(r.line.alias("line"), F.lit(None).cast("int").alias("nonblank"), r.text.alias("text")),
    )
    return numbered.select("path", F.inline(F.concat(full, blank)))


def squeeze_blank_lines(files: DataFrame) -> DataFrame:
    """Documents in which a run of blank lines is one line."""
    kept = F.filter(
        "lines",
        lambda text, i: ~(
            X.is_blank(text) & (i > 0) & X.is_blank(F.coalesce(F.get("lines", i - 1), F.lit("x")))
        ),
    )
    return files.select("path", _shown_lines("content", True).alias("lines")).select(
        "path", F.array_join(kept, "\n").alias("content")
    )
