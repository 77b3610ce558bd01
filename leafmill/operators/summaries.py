"""Derived summaries of every document and directory, kept up to date bottom-up.

A document is summarised from its text, a directory from the summaries of its children.
One Spark job per tree level works on all pending paths of that level at once.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import headers as H
from ..functions import paths as P
from ..functions import text as X
from ..session import broadcast_if_small, durable, pick
from .mutate import without_subtrees
from .tree import nodes as build_nodes

# Fixed values of the summary model.
MAX_SOURCE_BYTES = 200_000
ABSTRACT_LENGTH = 256
OVERVIEW_LENGTH = 8000
ATTEMPTS = 3

SCHEMA = (
    "path string, parent string, kind string, language string, source_hash string, "
    "abstract string, overview string, status string, error string, attempts int, "
    "updated_at timestamp"
)
COLUMNS = [part.split()[0] for part in SCHEMA.split(", ")]

Generator = Callable[[DataFrame], DataFrame]


def empty_summaries(spark) -> DataFrame:
    return spark.createDataFrame([], SCHEMA)


# --- generators ------------------------------------------------------------------


def extractive(requests: DataFrame) -> DataFrame:
    """Default generator: first lines of the sources.  Built-in functions only."""
    first_lines = F.transform("sources", lambda s: F.substring_index(s.body, "\n", 1))
    items = F.transform(
        "sources",
        lambda s: F.concat(F.lit("- "), s.path, F.lit(": "), F.substring_index(s.body, "\n", 1)),
    )
    return requests.select(
        "path",
        F.lit(True).alias("ok"),
        F.get(first_lines, F.lit(0)).alias("abstract"),
        F.array_join(items, "\n").alias("overview"),
        F.lit(None).cast("string").alias("error"),
    )


def python_generator(make: Callable[[dict], tuple[str, str]]) -> Generator:
    """Generator from a function of one request; an exception is a failed attempt."""

    def run(batches):
        for batch in batches:
            out = []
            for request in batch.to_dict("records"):
                request["sources"] = [dict(s) for s in request["sources"]]
                try:
                    abstract, overview = make(request)
                    out.append((request["path"], True, abstract, overview, None))
                except Exception as problem:  # noqa: BLE001 - the error is data
                    out.append((request["path"], False, None, None, str(problem) or repr(problem)))
            yield pd.DataFrame(out, columns=["path", "ok", "abstract", "overview", "error"])

    return lambda requests: requests.mapInPandas(
        run, "path string, ok boolean, abstract string, overview string, error string"
    )


def normalise(results: DataFrame) -> DataFrame:
    """Trim and cut the generated texts; an empty text is a failure."""
    abstract, overview = X.trim("abstract"), X.trim("overview")
    filled = F.col("ok") & (F.coalesce(abstract, F.lit("")) != "") & (F.coalesce(overview, F.lit("")) != "")
    return results.select(
        "path",
        filled.alias("ok"),
        F.when(filled, X.cut_chars(abstract, ABSTRACT_LENGTH)).alias("abstract"),
        F.when(filled, X.cut_chars(overview, OVERVIEW_LENGTH)).alias("overview"),
        F.when(~filled, F.coalesce("error", F.lit("the generator returned an empty field"))).alias("error"),
    )


def generate_with_retries(requests: DataFrame, generate: Generator) -> DataFrame:
    """Results of all requests; failed ones are tried again, to three attempts."""
    todo, done = requests, None
    for attempt in range(1, ATTEMPTS + 1):
        results = durable(
            normalise(generate(todo)).withColumn("attempts", F.lit(attempt)), "generated"
        )
        last = attempt == ATTEMPTS or not results.filter("not ok").limit(1).count()
        part = results if last else results.filter("ok")
        done = part if done is None else done.unionByName(part)
        if last:
            return done
        todo = todo.join(results.filter("not ok").select("path"), "path", "left_semi")
    return done


# --- sources ---------------------------------------------------------------------


def document_sources(files: DataFrame) -> DataFrame:
    """(path, sources, input_error): trimmed body, cut to the byte limit."""
    text = X.cut_bytes(X.trim("body"), MAX_SOURCE_BYTES)
    source = F.array(F.struct(F.col("path").alias("path"), F.col("text").alias("body")))
    return (
        H.parse_headers(files.select("path", "content"))
        .select("path", "metadata_error", text.alias("text"))
        .select(
            "path",
            F.when(F.col("text") != "", source)
            .otherwise(F.slice(source, 1, 0))
            .alias("sources"),
            F.col("metadata_error").alias("input_error"),
        )
    )


def _known_children(children: DataFrame) -> DataFrame:
    """Children with a text: the path to show, the short and the long text, and the least
    number of bytes that the child takes."""
    is_file = F.col("kind") == "file"
    long_text = F.when(is_file & (F.col("overview") != ""), F.col("overview")).otherwise(F.col("abstract"))
    shown = F.when(is_file, F.col("path")).otherwise(F.concat("path", F.lit("/")))
    short = F.when(F.col("abstract") != "", F.octet_length("abstract")).otherwise(F.octet_length("long_text"))
    return (
        children.select("parent", "path", shown.alias("shown"), "abstract", long_text.alias("long_text"))
        .filter("long_text <> ''")
        .withColumn("least", F.octet_length("shown") + F.least(F.octet_length("long_text"), short))
    )


def fitting_children(children: DataFrame, limit: int = MAX_SOURCE_BYTES) -> int:
    """How many children of one directory can fit into the byte limit at most."""
    smallest = _known_children(children).agg(F.min("least")).first()[0]
    return limit // smallest + 1 if smallest else 1


def child_sources(
    children: DataFrame, limit: int = MAX_SOURCE_BYTES, fitting: int | None = None
) -> DataFrame:
    """(parent, sources) from child rows (parent, path, kind, abstract, overview).

    Sizes and counts come from a partial aggregate.  The children that can fit are the first
    few thousand by path, because each one needs some bytes; a top-k window keeps only those
    per task before the shuffle, so one huge directory never meets in one group.
    """
    known = _known_children(children)
    shown_size = F.octet_length("shown")
    totals = known.groupBy("parent").agg(
        F.sum((shown_size + F.octet_length("long_text")).cast("bigint")).alias("long_bytes"),
        F.count(F.lit(1)).alias("known"),
    )
    fitting = fitting_children(children, limit) if fitting is None else fitting
    by_path = Window.partitionBy("parent").orderBy("path")
    first = known.withColumn("n", F.row_number().over(by_path)).filter(F.col("n") <= fitting)
    body = F.when((F.col("long_bytes") > limit) & (F.col("abstract") != ""), F.col("abstract")).otherwise(
        F.col("long_text")
    )
    sized = first.join(totals, "parent").withColumn("body", body)
    running = F.sum(F.octet_length("shown") + F.octet_length("body")).over(
        by_path.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    kept = (
        sized.withColumn("running", running)
        .filter(F.col("running") <= limit)
        .groupBy("parent")
        .agg(F.array_sort(F.collect_list(F.struct("n", "shown", "body"))).alias("kept"))
    )
    empty = F.array().cast("array<struct<n:int,shown:string,body:string>>")
    rows = totals.join(kept, "parent", "left").withColumn("kept", F.coalesce("kept", empty))
    shown = F.transform("kept", lambda k: F.struct(k.shown.alias("path"), k.body.alias("body")))
    more = F.col("known") - F.size("kept")
    note = F.concat(more.cast("string"), F.lit(" more children are not in this list."))
    rest = F.array(F.struct(F.lit("").alias("path"), note.alias("body")))
    return rows.select(
        "parent", F.when(more > 0, F.concat(shown, rest)).otherwise(shown).alias("sources")
    )


# --- invalidation and backfill ----------------------------------------------------


def with_ancestors(paths: DataFrame, root: str = "/") -> DataFrame:
    """The paths and their ancestors inside ``root``, without repeats."""
    direct = paths.select(P.parent("path").alias("path")).filter("path <> ''").distinct()
    above = direct.select(F.explode(P.ancestors("path", include_self=True)).alias("path"))
    return paths.select("path").unionByName(above).filter(P.under("path", root)).distinct()


def dirty_paths(changes: DataFrame) -> DataFrame:
    """Paths to refresh after changes (path, deleted): ancestors, and a written path itself."""
    written = changes.filter("not deleted").select("path")
    above_deleted = changes.filter("deleted").select(P.parent("path").alias("path"))
    return with_ancestors(written.unionByName(above_deleted).distinct())


def invalidate(
    summaries: DataFrame, changes: DataFrame, language: str, insert: bool = True
) -> DataFrame:
    """Summaries after writes: touched rows become stale, removed subtrees lose their rows.

    With ``insert`` (a generator is configured) paths without a row get a stale one.
    """
    alive = without_subtrees(summaries, changes.filter("deleted").select("path"))
    dirty = dirty_paths(changes).withColumn("dirty", F.lit(True))
    joined = alive.join(dirty, "path", "full" if insert else "left")
    written = changes.filter("not deleted").select("path").distinct().withColumn("is_file", F.lit(True))
    joined = joined.join(broadcast_if_small(written), "path", "left")
    stale = F.coalesce("dirty", F.lit(False))
    return joined.select(
        "path",
        F.coalesce("parent", P.parent("path")).alias("parent"),
        F.when(F.col("is_file"), F.lit("file")).otherwise(F.coalesce("kind", F.lit("dir"))).alias("kind"),
        F.coalesce("language", F.lit(language)).alias("language"),
        F.coalesce("source_hash", F.lit("")).alias("source_hash"),
        F.coalesce("abstract", F.lit("")).alias("abstract"),
        F.coalesce("overview", F.lit("")).alias("overview"),
        F.when(stale, F.lit("stale")).otherwise(F.col("status")).alias("status"),
        F.when(stale, F.lit("")).otherwise(F.col("error")).alias("error"),
        F.when(stale, F.lit(0)).otherwise(F.col("attempts")).alias("attempts"),
        "updated_at",
    )


def backfill(tree: DataFrame, summaries: DataFrame, language: str, root: str = "/") -> DataFrame:
    """Paths that need a summary: without a row, failed, or ready in another language; and
    their ancestors inside the root."""
    missing = tree.select("path").join(summaries.select("path"), "path", "left_anti")
    redo = summaries.filter(
        (F.col("status") == "failed") | ((F.col("status") == "ready") & (F.col("language") != language))
    ).select("path")
    return with_ancestors(missing.unionByName(redo).filter(P.under("path", root)), root)


def without_vanished(summaries: DataFrame, tree: DataFrame) -> DataFrame:
    return summaries.join(tree.select("path"), "path", "left_semi")


def ready_jobs(summaries: DataFrame) -> DataFrame:
    """Stale rows that no stale child holds back."""
    stale = summaries.filter("status = 'stale'")
    waiting = stale.select(F.col("parent").alias("path")).distinct()
    return stale.join(waiting, "path", "left_anti")


# --- roll-up ---------------------------------------------------------------------


@dataclass(frozen=True)
class Rollup:
    """New summaries, and the paths for which the generator was called."""

    summaries: DataFrame
    calls: DataFrame


def rollup(
    files: DataFrame,
    language: str,
    summaries: DataFrame | None = None,
    generate: Generator = extractive,
    root: str = "/",
    force_paths: DataFrame | None = None,
    now: Column | None = None,
) -> Rollup:
    """Bring the summaries up to date.

    Pending are stale rows, paths that need a backfill below ``root``, and forced paths (for
    which the generator runs also on unchanged input).  Levels run deepest first; a path of
    the next level joins when a child's text changed.
    """
    spark = files.sparkSession
    now = F.current_timestamp() if now is None else now
    depth = P.depth("path")
    slim = [c for c in files.columns if c in ("path", "size", "mtime", "content_hash")]
    tree = durable(
        build_nodes(files.select(*slim)).select("path", "parent", "kind", depth.alias("depth")), "nodes"
    )
    previous = empty_summaries(spark) if summaries is None else summaries
    previous = durable(
        previous.drop("kind", "parent").join(tree, "path").select(*COLUMNS, "depth"), "summaries"
    )
    pending = backfill(tree, previous, language, root).unionByName(
        previous.filter("status = 'stale'").select("path")
    )
    forced = spark.createDataFrame([], "path string")
    if force_paths is not None:
        forced = with_ancestors(force_paths.select(P.clean("path").alias("path")), root).join(
            force_paths.select(P.clean("path").alias("path")), "path", "left_semi"
        )
        pending = pending.unionByName(forced)
    pending = durable(pending.distinct().join(tree, "path"), "pending")
    levels = pending.agg(F.max("depth")).first()[0]
    if levels is None:
        return Rollup(previous.select(*COLUMNS), spark.createDataFrame([], "path string"))

    done: dict[int, DataFrame] = {}
    calls = spark.createDataFrame([], "path string")
    raised = None
    for level in range(levels, -1, -1):
        jobs = pending.filter(F.col("depth") == level)
        if raised is not None:
            jobs = jobs.unionByName(
                tree.filter(F.col("depth") == level).join(raised, "path", "left_semi")
            ).distinct()
        kinds = {r.kind for r in jobs.select("kind").distinct().collect()}
        raised = None
        if not kinds:
            continue
        children = previous.filter(F.col("depth") == level + 1).select(*COLUMNS)
        if level + 1 in done:
            redone = done[level + 1].select(*COLUMNS)
            children = children.join(redone.select("path"), "path", "left_anti").unionByName(redone)
        done[level], called = _level(
            files, jobs, kinds, children, previous.filter(F.col("depth") == level), forced, language, generate, now
        )
        calls = calls.unionByName(called)
        raised = done[level].filter("changed").select(F.col("parent").alias("path")).filter("path <> ''").distinct()

    if not done:
        return Rollup(previous.select(*COLUMNS), calls)
    updated = reduce(DataFrame.unionByName, [rows.select(*COLUMNS) for rows in done.values()])
    kept = previous.join(updated.select("path"), "path", "left_anti").select(*COLUMNS)
    return Rollup(kept.unionByName(updated), calls)


def _level(files, jobs, kinds, children, previous, forced, language, generate, now):
    """One level: decide per job, generate where needed, and the new rows of the jobs.

    The decisions are a slim table without texts.  The sources of the paths that need the
    generator are read again, so no copy of the document texts is written.
    """

    fitting = fitting_children(children) if "dir" in kinds else None

    def sources_of(paths: DataFrame) -> DataFrame:
        parts = []
        if "file" in kinds:
            wanted = paths.filter("kind = 'file'").select("path")
            parts.append(document_sources(pick(files.select("path", "content"), wanted)))
        if "dir" in kinds:
            folders = paths.filter("kind = 'dir'").select(F.col("path").alias("parent"))
            parts.append(
                child_sources(children.join(folders, "parent", "left_semi"), fitting=fitting).select(
                    F.col("parent").alias("path"), "sources", F.lit(None).cast("string").alias("input_error")
                )
            )
        return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])

    none = F.array().cast("array<struct<path:string,body:string>>")
    old = previous.select(
        "path", F.col("language").alias("old_language"), F.col("source_hash").alias("old_hash"),
        F.col("abstract").alias("old_abstract"), F.col("overview").alias("old_overview"),
        F.col("updated_at").alias("old_updated_at"),
    )
    inputs = sources_of(jobs).select(
        "path", "input_error", F.size("sources").alias("n_sources"),
        X.content_hash(F.to_json("sources")).alias("new_hash"),
    )
    rows = (
        jobs.join(inputs, "path", "left")
        .withColumn("n_sources", F.coalesce("n_sources", F.lit(0)))
        .withColumn("new_hash", F.coalesce("new_hash", X.content_hash(F.to_json(none))))
        .join(old, "path", "left")
        .join(forced.withColumn("force", F.lit(True)), "path", "left")
        .fillna("", ["old_language", "old_hash", "old_abstract", "old_overview"])
    )
    has_text = (F.col("old_abstract") != "") | (F.col("old_overview") != "")
    unchanged = (
        (F.col("old_hash") == F.col("new_hash")) & (F.col("old_language") == language) & has_text
        & F.col("force").isNull()
    )
    action = (
        F.when(F.col("input_error").isNotNull(), F.lit("invalid"))
        .when(F.col("n_sources") == 0, F.lit("empty"))
        .when(unchanged, F.lit("keep"))
        .otherwise(F.lit("generate"))
    )
    rows = durable(rows.withColumn("action", action), "decisions")
    called = rows.filter("action = 'generate'").select("path", "kind")
    if called.limit(1).count():
        requests = called.join(sources_of(called), "path").select(
            "path", F.lit(language).alias("language"), (F.col("kind") == "dir").alias("directory"), "sources"
        )
        results = generate_with_retries(requests, generate).withColumnRenamed("error", "generate_error")
        merged = rows.join(results.drop("attempts"), "path", "left")
    else:
        merged = rows.withColumns(
            {
                "ok": F.lit(False),
                **{c: F.lit(None).cast("string") for c in ("abstract", "overview", "generate_error")},
            }
        )
    failed = (F.col("action") == "invalid") | (
        (F.col("action") == "generate") & ~F.coalesce("ok", F.lit(False))
    )

    def text(new: str, was: str) -> Column:
        return (
            F.when(failed | (F.col("action") == "keep"), F.col(was))
            .when(F.col("action") == "empty", F.lit(""))
            .otherwise(F.col(new))
        )

    merged = merged.withColumns({"_abstract": text("abstract", "old_abstract"), "_overview": text("overview", "old_overview")})
    changed = (F.col("_abstract") != F.col("old_abstract")) | (F.col("_overview") != F.col("old_overview"))
    finished = merged.select(
        "path", "parent", "kind",
        F.when(failed & (F.col("old_language") != ""), F.col("old_language")).otherwise(F.lit(language)).alias("language"),
        F.when(failed, F.col("old_hash")).otherwise(F.col("new_hash")).alias("source_hash"),
        F.col("_abstract").alias("abstract"),
        F.col("_overview").alias("overview"),
        F.when(failed, F.lit("failed")).otherwise(F.lit("ready")).alias("status"),
        F.when(failed, F.coalesce("input_error", "generate_error", F.lit("failed"))).otherwise(F.lit("")).alias("error"),
        F.when(failed, F.lit(ATTEMPTS)).otherwise(F.lit(0)).alias("attempts"),
        F.when(changed | failed, now).otherwise(F.coalesce("old_updated_at", now)).alias("updated_at"),
        (changed & ~failed).alias("changed"),
    )
    return durable(finished, "level"), called.select("path")


# --- lookups and exports ----------------------------------------------------------


def status(requests: DataFrame, tree: DataFrame, summaries: DataFrame, language: str) -> DataFrame:
    """Summary of requested paths: NOT_FOUND, missing, stale (also for another language), ..."""
    wanted = requests.withColumn("path", P.clean("path"))
    rows = wanted.join(tree.select("path", F.lit(True).alias("exists")), "path", "left").join(
        summaries.select("path", "language", "source_hash", "abstract", "overview", "status", "error"), "path", "left"
    )
    other = (F.col("status") == "ready") & (F.col("language") != language)
    return rows.select(
        *wanted.columns,
        F.when(F.col("exists").isNull(), F.lit("NOT_FOUND"))
        .when(F.col("status").isNull(), F.lit("missing"))
        .when(other, F.lit("stale"))
        .otherwise(F.col("status"))
        .alias("status"),
        F.coalesce("language", F.lit(language)).alias("language"),
        F.coalesce("abstract", F.lit("")).alias("abstract"),
        F.coalesce("overview", F.lit("")).alias("overview"),
        F.when(other, F.lit("language changed; refresh this summary")).otherwise(F.coalesce("error", F.lit(""))).alias("error"),
    )


def _yaml_text(value: Column) -> Column:
    """A YAML scalar: plain when that is safe, else in double quotes."""
    escaped = F.replace(F.replace(value, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    return F.when(value.rlike(r"\A[A-Za-z/][A-Za-z0-9_./:-]*\z"), value).otherwise(
        F.concat(F.lit('"'), escaped, F.lit('"'))
    )


def sidecars(summaries: DataFrame, generated_by: str = "leafmill") -> DataFrame:
    """Directory summaries as documents: ``.abstract.md`` and ``.overview.md``.

    They are for export only; listings and searches do not contain them.
    """
    header = F.concat(
        F.lit("---\ndirectory: "), _yaml_text(F.col("path")),
        F.lit(f"\ngenerated_by: {generated_by}\nlanguage: "), F.col("language"),
        F.lit("\nsource_hash: "), _yaml_text(F.col("source_hash")),
        F.lit("\nstatus: "), F.col("status"), F.lit("\n---\n\n"),
    )
    prefix = F.when(F.col("path") == "/", F.lit("/")).otherwise(F.concat("path", F.lit("/")))
    return (
        summaries.filter("kind = 'dir'")
        .select(
            header.alias("header"), prefix.alias("prefix"),
            F.inline(
                F.array(
                    F.struct(F.lit(P.SIDECARS[0]).alias("file"), F.col("abstract").alias("body")),
                    F.struct(F.lit(P.SIDECARS[1]).alias("file"), F.col("overview").alias("body")),
                )
            ),
        )
        .filter("body <> ''")
        .select(
            F.concat("prefix", "file").alias("path"),
            F.concat("header", "body", F.lit("\n")).alias("content"),
        )
        .withColumn("content_hash", X.content_hash("content"))
    )
