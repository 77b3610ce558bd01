"""Line search over document content.  One pass over the scan, no shuffle."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import paths as P
from ..functions import text as X
from ..functions.patterns import PatternError, java_regex, shell_name, whole_word
from .errors import InvalidParameter
from .tree import require_directory


def line_test(
    pattern: str,
    regex: bool = False,
    ignore_case: bool = False,
    whole_word_only: bool = False,
    whole_line: bool = False,
    invert: bool = False,
) -> Callable[[Column], Column]:
    """The predicate of one request, as a function of a line column."""
    if regex:
        wrapped = pattern
        if whole_word_only:
            wrapped = rf"\b{wrapped}\b"
        if whole_line:
            wrapped = f"^{wrapped}$"
        try:
            expression = java_regex(wrapped, ignore_case)
        except PatternError as problem:
            raise InvalidParameter(str(problem)) from problem

        def test(line: Column) -> Column:
            return line.rlike(expression)
    else:
        wanted = pattern.lower() if ignore_case else pattern

        def test(line: Column) -> Column:
            line = X.lower(line) if ignore_case else line
            if whole_line:
                return line == F.lit(wanted)
            found = F.contains(line, F.lit(wanted))
            return found & line.rlike(whole_word(wanted)) if whole_word_only else found

    return (lambda line: ~test(line)) if invert else test


def _document_filter(
    files: DataFrame, root: str, show_all: bool, include: str, exclude: str
) -> DataFrame:
    rows = files.filter(P.below("path", root))
    if not show_all:
        rows = rows.filter(~P.hidden("path", root))
    if include:
        try:
            rows = rows.filter(P.name("path").rlike(shell_name(include)))
        except PatternError:
            rows = rows.filter(F.lit(False))
    if exclude:
        try:
            rows = rows.filter(~P.name("path").rlike(shell_name(exclude)))
        except PatternError:
            pass
    return rows


def _documents(
    files: DataFrame,
    pattern: str,
    path: str,
    show_all: bool,
    include: str,
    exclude: str,
    line_options: dict,
) -> DataFrame:
    """Documents that can have a match: path filters, then a whole-content test."""
    rows = _document_filter(files, require_directory(files, path), show_all, include, exclude)
    if not line_options.get("regex") and not line_options.get("invert"):
        ignore_case = line_options.get("ignore_case", False)
        content = X.lower("content") if ignore_case else F.col("content")
        rows = rows.filter(F.contains(content, F.lit(pattern.lower() if ignore_case else pattern)))
    return rows


def grep(
    files: DataFrame,
    pattern: str,
    path: str = "/",
    before: int = 0,
    after: int = 0,
    show_all: bool = False,
    include: str = "",
    exclude: str = "",
    **line_options,
) -> DataFrame:
    """Matches (path, line, text, before, after).

    Contexts of neighbouring matches overlap; they are not merged.
    """
    test = line_test(pattern, **line_options)
    rows = _documents(files, pattern, path, show_all, include, exclude, line_options)
    if before <= 0 and after <= 0:
        empty = F.array().cast("array<string>")
        return (
            rows.select("path", F.posexplode(X.lines("content")).alias("pos", "text"))
            .filter(test(F.col("text")))
            .select("path", (F.col("pos") + 1).alias("line"), "text", empty.alias("before"), empty.alias("after"))
        )
    at = F.col("pos")
    return (
        rows.select("path", X.lines("content").alias("lines"))
        .select("path", "lines", F.posexplode("lines").alias("pos", "text"))
        .filter(test(F.col("text")))
        .select(
            "path",
            (at + 1).alias("line"),
            "text",
            F.slice("lines", F.greatest(at - before, F.lit(0)) + 1, F.least(at, F.lit(max(before, 0)))).alias("before"),
            F.slice("lines", at + 2, F.lit(max(after, 0))).alias("after"),
        )
    )


def grep_files(files: DataFrame, pattern: str, path: str = "/", show_all: bool = False,
               include: str = "", exclude: str = "", **line_options) -> DataFrame:
    """Paths with at least one match."""
    test = line_test(pattern, **line_options)
    rows = _documents(files, pattern, path, show_all, include, exclude, line_options)
    return rows.filter(F.exists(X.lines("content"), test)).select("path")


def grep_count(files: DataFrame, pattern: str, path: str = "/", show_all: bool = False,
               include: str = "", exclude: str = "", **line_options) -> DataFrame:
    """Matched lines per path, for the paths that have a match."""
    test = line_test(pattern, **line_options)
    rows = _documents(files, pattern, path, show_all, include, exclude, line_options)
    return rows.select("path", F.size(F.filter(X.lines("content"), test)).alias("matches")).filter(
        "matches > 0"
    )


def grep_only(files: DataFrame, pattern: str, **options) -> DataFrame:
    """One row per occurrence of a literal in the matched lines.

    The occurrences are case-sensitive also when the lines match without case.  With a
    regular expression the whole line is the result.
    """
    matches = grep(files, pattern, **options)
    if options.get("regex"):
        return matches.select("path", "line", "text")
    if not pattern:
        raise InvalidParameter("an empty pattern has no occurrences")
    times = X.occurrences("text", F.lit(pattern))
    return matches.select(
        "path", "line", F.explode(F.array_repeat(F.lit(pattern), times)).alias("text")
    )


def grep_many(files: DataFrame, patterns: Sequence[str], path: str = "/", show_all: bool = False,
              include: str = "", exclude: str = "", **line_options) -> DataFrame:
    """Matches (pattern, path, line, text) of several patterns in one pass."""
    tests = [(pattern, line_test(pattern, **line_options)) for pattern in dict.fromkeys(patterns)]
    rows = _document_filter(files, require_directory(files, path), show_all, include, exclude)
    text = F.col("text")
    found = F.array_compact(F.array(*[F.when(test(text), F.lit(p)) for p, test in tests]))
    return (
        rows.select("path", F.posexplode(X.lines("content")).alias("pos", "text"))
        .select("path", (F.col("pos") + 1).alias("line"), "text", F.explode(found).alias("pattern"))
    )


def pattern_checks(files: DataFrame, checks: Sequence[tuple[str, str]]) -> DataFrame:
    """(label, pattern, status): does any line of the corpus fit each expression?

    ``checks`` are (label, expression) pairs; case is ignored.  One scan, one aggregate.
    """
    fits = [
        F.bool_or(F.exists(X.lines("content"), line_test(pattern, regex=True, ignore_case=True)))
        for _, pattern in checks
    ]
    row = files.agg(*[F.coalesce(fit, F.lit(False)).alias(f"c{i}") for i, fit in enumerate(fits)])
    return row.select(
        F.inline(
            F.array(
                *[
                    F.struct(
                        F.lit(label).alias("label"),
                        F.lit(pattern).alias("pattern"),
                        F.when(F.col(f"c{i}"), F.lit("PASS")).otherwise(F.lit("FAIL")).alias("status"),
                    )
                    for i, (label, pattern) in enumerate(checks)
                ]
            )
        )
    )
