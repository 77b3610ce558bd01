"""Batches of conditional writes: a files table and a request table give a new files table
and one outcome per request, as if the requests ran one after the other by ``seq``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import headers as H
from ..functions import paths as P
from ..functions import text as X
from ..functions.headers import document_problem
from ..session import broadcast_if_small, durable, pick
from .tree import directories

FILE_COLUMNS = ("path", "title", "content", "size", "mtime", "content_hash", "revision")
REQUEST_SCHEMA = (
    "seq bigint, op string, path string, content string, old string, new string, "
    "every boolean, expected_hash string, ts timestamp"
)


@dataclass(frozen=True)
class Changes:
    """What a batch did: rows to insert or replace, removed subtree roots, outcomes."""

    upserts: DataFrame
    removed: DataFrame
    outcomes: DataFrame


# --- static checks ---------------------------------------------------------------


def validate(requests: DataFrame) -> DataFrame:
    """Requests with a cleaned path and ``code``: the outcome that needs no state."""
    reason = P.reject_reason("path")
    root = F.when(F.col("op") == "delete", F.lit("CANNOT_DELETE_ROOT")).otherwise(F.lit("IS_DIR"))
    code = (
        F.when(~F.col("op").isin("put", "edit", "delete"), F.lit("INVALID_PARAM"))
        .when(reason == "ROOT", root)
        .when(reason.isNotNull(), F.lit("INVALID_PARAM"))
        .when((F.col("op") == "edit") & (F.coalesce("old", F.lit("")) == ""), F.lit("EMPTY_OLD"))
    )
    filled = requests.select(
        "seq", "op", "path",
        F.coalesce("content", F.lit("")).alias("content"),
        F.coalesce("old", F.lit("")).alias("old"),
        F.coalesce("new", F.lit("")).alias("new"),
        F.coalesce("every", F.lit(False)).alias("every"),
        F.coalesce("expected_hash", F.lit("")).alias("expected_hash"),
        "ts",
    )
    return filled.withColumn("code", code).withColumn("path", P.clean("path"))


def hash_conflict(expected: Column, actual: Column, exists: Column) -> Column:
    """Empty always passes, ``*`` wants no document, other text wants that hash."""
    return (
        F.when(expected == "", F.lit(False))
        .when(expected == "*", exists)
        .otherwise(~exists | ~F.coalesce(actual == expected, F.lit(False)))
    )


# --- state of the requested paths -------------------------------------------------


def without_subtrees(files: DataFrame, roots: DataFrame) -> DataFrame:
    """Files that are neither one of the roots nor below one."""
    sample = [r[0] for r in roots.select("path").distinct().limit(501).collect()]
    if not sample:
        return files
    if len(sample) <= 500:
        return files.filter(~F.exists(P.ancestors("path", include_self=True), lambda a: a.isin(sample)))
    killed = (
        files.select("path", F.explode(P.ancestors("path", include_self=True)).alias("root"))
        .join(broadcast_if_small(roots.select(F.col("path").alias("root")).distinct()), "root", "left_semi")
        .select("path")
        .distinct()
    )
    return files.join(killed, "path", "left_anti")


def overlay(files: DataFrame, upserts: DataFrame, removed: DataFrame) -> DataFrame:
    """The files table after some changes."""
    kept = without_subtrees(files, removed)
    replaced = broadcast_if_small(upserts.select("path"))
    return kept.join(replaced, "path", "left_anti").select(*FILE_COLUMNS).unionByName(
        upserts.select(*FILE_COLUMNS)
    )


def _path_state(current: DataFrame, paths: DataFrame) -> DataFrame:
    """For each requested path: its document, whether it is a directory, and whether a
    document stands where one of its directories should be."""
    own = pick(current, paths).select("path", "title", "content", "content_hash", "revision", "mtime")
    dirs = directories(current).select("path").join(paths, "path", "left_semi")
    above = paths.select("path", F.explode(P.ancestors("path")).alias("above")).filter("above <> '/'")
    file_paths = current.select(F.col("path").alias("above"))
    blocking = pick(file_paths, above.select("above"), "above")
    blocked = above.join(blocking, "above", "left_semi").select("path").distinct()
    return (
        paths.join(own, "path", "left")
        .join(dirs.withColumn("is_dir", F.lit(True)), "path", "left")
        .join(blocked.withColumn("blocked", F.lit(True)), "path", "left")
        .select(
            "path", "title", "content", "content_hash", "mtime",
            F.coalesce("revision", F.lit(0)).cast("bigint").alias("revision"),
            F.col("content_hash").isNotNull().alias("present"),
            F.coalesce("is_dir", F.lit(False)).alias("is_dir"),
            F.coalesce("blocked", F.lit(False)).alias("blocked"),
        )
    )


# --- one block: no request path is above another ----------------------------------


def _decided(requests: DataFrame, state: DataFrame) -> DataFrame:
    """Outcome of requests whose path state does not depend on other requests."""
    base = state.select(
        "path", "present", "is_dir", "blocked", "revision",
        F.col("title").alias("old_title"), F.col("content").alias("old_content"),
        F.col("content_hash").alias("old_hash"),
    )
    rows = requests.join(base, "path")
    put, edit = F.col("op") == "put", F.col("op") == "edit"
    hits = F.when(edit, X.occurrences("old_content", F.col("old"))).otherwise(F.lit(0))
    edited = F.when(F.col("every"), F.replace("old_content", F.col("old"), F.col("new"))).otherwise(
        X.replace_first("old_content", F.col("old"), F.col("new"))
    )
    rows = rows.withColumn("hits", F.coalesce(hits, F.lit(0))).withColumn(
        "content", F.when(put, F.col("content")).when(edit, edited)
    )
    rows = H.parse_headers(rows)
    conflict = hash_conflict(F.col("expected_hash"), F.col("old_hash"), F.col("present"))
    wrong_header = F.col("metadata_error").isNotNull()
    outcome = (
        F.when(
            put,
            F.when(F.col("is_dir"), F.lit("IS_DIR"))
            .when(F.col("blocked"), F.lit("NOT_DIR"))
            .when(conflict, F.lit("CONFLICT"))
            .when(wrong_header, F.lit("INVALID_PARAM")),
        )
        .when(
            edit,
            F.when(~F.col("present"), F.lit("NOT_FOUND"))
            .when(conflict, F.lit("CONFLICT"))
            .when(F.col("hits") == 0, F.lit("OLD_NOT_FOUND"))
            .when(wrong_header, F.lit("INVALID_PARAM")),
        )
        .otherwise(
            F.when((F.col("expected_hash") != "") & ~F.col("present"), F.lit("NOT_FOUND"))
            .when((F.col("expected_hash") != "") & (F.col("expected_hash") != F.col("old_hash")), F.lit("CONFLICT"))
            .when(~F.col("present") & ~F.col("is_dir"), F.lit("NOT_FOUND"))
        )
    )
    return rows.withColumn("outcome", F.coalesce(outcome, F.lit("OK"))).withColumn(
        "replaced",
        F.when(edit & (F.col("outcome") == "OK"), F.when(F.col("every"), F.col("hits")).otherwise(F.lit(1)))
        .otherwise(F.lit(0)),
    )


_FOLDED = (
    "row string, seq bigint, path string, op string, outcome string, replaced int, title string, "
    "content string, content_hash string, revision bigint, ts bigint, present boolean, removed boolean"
)


def _fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Apply requests of several paths in order; holds one document state at a time.

    Rows come sorted by (path, seq); the first row of a path has its state.
    """
    state: dict | None = None

    def digest(text):
        return "sha256:" + hashlib.sha256(text.encode()).hexdigest()

    def final():
        keys = ("path", "title", "content", "content_hash", "revision", "ts", "present", "removed")
        return {"row": "final", **{key: state[key] for key in keys}}

    def step(request):
        expected, present = request.expected_hash, state["present"]
        conflict = bool(expected) and (
            present if expected == "*" else not present or state["content_hash"] != expected
        )
        replaced = 0
        if request.op == "delete":
            if expected and (not present or state["content_hash"] != expected):
                return ("CONFLICT" if present else "NOT_FOUND"), 0
            if not present and not state["is_dir"]:
                return "NOT_FOUND", 0
            state.update(present=False, is_dir=False, removed=True, touched=True, revision=0)
            return "OK", 0
        if request.op == "put":
            if state["is_dir"] or state["blocked"]:
                return ("IS_DIR" if state["is_dir"] else "NOT_DIR"), 0
            content, title = request.content, request.path.rsplit("/", 1)[1]
        else:
            if not present:
                return "NOT_FOUND", 0
            title, replaced = state["title"], state["content"].count(request.old)
            if conflict or not replaced:
                return ("CONFLICT" if conflict else "OLD_NOT_FOUND"), 0
            replaced = replaced if request.every else 1
            content = state["content"].replace(request.old, request.new, replaced)
        if conflict:
            return "CONFLICT", 0
        if document_problem(request.path, content):
            return "INVALID_PARAM", 0
        state.update(
            present=True, content=content, title=title, content_hash=digest(content),
            revision=state["revision"] + 1, ts=request.ts, touched=True,
        )
        return "OK", replaced

    columns = [part.split()[0] for part in _FOLDED.split(", ")]
    for batch in batches:
        out = []
        for request in batch.itertuples(index=False):
            if state is None or state["path"] != request.path:
                if state is not None and state["touched"]:
                    out.append(final())
                state = {
                    "path": request.path, "title": request.title, "content": request.content,
                    "content_hash": request.content_hash, "revision": int(request.revision),
                    "ts": request.ts, "present": bool(request.present), "removed": False, "touched": False,
                    "is_dir": bool(request.is_dir), "blocked": bool(request.blocked),
                }
                continue
            outcome, replaced = step(request)
            out.append({"row": "request", "seq": request.seq, "path": request.path, "op": request.op,
                        "outcome": outcome, "replaced": replaced})
        yield pd.DataFrame(out, columns=columns, dtype=object)
    if state is not None and state["touched"]:
        yield pd.DataFrame([final()], columns=columns, dtype=object)


def _chained(requests: DataFrame, state: DataFrame) -> DataFrame:
    """Fold paths with several dependent requests.

    The rows of a path stream through one task in ``seq`` order, because each condition
    depends on the write before it; they are never collected as a group.
    """
    first = state.select(
        F.lit(-1).cast("bigint").alias("order"), F.lit(None).cast("bigint").alias("seq"), F.lit("state").alias("op"), "path", "content",
        F.lit("").alias("old"), F.lit("").alias("new"), F.lit(False).alias("every"),
        F.lit("").alias("expected_hash"), F.unix_micros("mtime").alias("ts"),
        "title", "content_hash", "revision", "present", "is_dir", "blocked",
    )
    rest = requests.select(
        F.col("seq").alias("order"), "seq", "op", "path", "content", "old", "new", "every", "expected_hash",
        F.unix_micros("ts").alias("ts"), F.lit(None).cast("string").alias("title"), F.lit(None).cast("string").alias("content_hash"),
        F.lit(0).cast("bigint").alias("revision"), F.lit(False).alias("present"),
        F.lit(False).alias("is_dir"), F.lit(False).alias("blocked"),
    )
    is_state = F.when(F.col("op") == "state", F.lit(0)).otherwise(F.lit(1))
    return (
        first.unionByName(rest)
        .withColumn("rank", is_state)
        .repartition("path")
        .sortWithinPartitions("path", "rank", "order")
        .drop("order", "rank")
        .mapInPandas(_fold, _FOLDED)
    )


def _apply_block(current: DataFrame, block: DataFrame) -> Changes:
    per_path = block.groupBy("path").agg(
        F.count(F.lit(1)).alias("n"),
        F.bool_and((F.col("op") == "put") & (F.col("expected_hash") == "")).alias("plain_puts"),
    )
    per_path = durable(per_path, "paths")
    state = durable(_path_state(current, per_path.select("path")), "state")
    simple = per_path.filter("n = 1 or plain_puts").select("path")
    chains = per_path.filter("n > 1 and not plain_puts").select("path")

    kinds = per_path.agg(
        F.count_if((F.col("n") > 1) & ~F.col("plain_puts")).alias("chains"),
    ).first()
    decided = durable(_decided(block.join(simple, "path", "left_semi"), state), "decided")
    applied = decided.filter("outcome = 'OK' and op <> 'delete'")
    written = (
        applied.groupBy("path")
        .agg(
            F.max_by(F.struct("content", "ts", "op", "old_title"), "seq").alias("last"),
            F.count(F.lit(1)).alias("writes"),
            F.max("revision").alias("revision"),
        )
        .select(
            "path",
            F.when(F.col("last.op") == "edit", F.col("last.old_title")).otherwise(P.name("path")).alias("title"),
            F.col("last.content").alias("content"),
            F.octet_length("last.content").cast("bigint").alias("size"),
            F.col("last.ts").alias("mtime"),
            X.content_hash("last.content").alias("content_hash"),
            (F.col("revision") + F.col("writes")).alias("revision"),
        )
    )
    removed = decided.filter("outcome = 'OK' and op = 'delete'").select("path")
    outcomes = decided.select("seq", "op", "path", "outcome", "replaced")
    if not kinds.chains:
        return Changes(written, removed, outcomes)
    folded = durable(
        _chained(block.join(chains, "path", "left_semi"), state.join(chains, "path", "left_semi")), "folded"
    )
    finals = folded.filter("row = 'final'")
    folded_files = finals.filter("present").select(
        "path", "title", "content", F.octet_length("content").cast("bigint").alias("size"),
        F.timestamp_micros("ts").alias("mtime"), "content_hash", "revision",
    )
    return Changes(
        written.unionByName(folded_files),
        removed.unionByName(finals.filter("removed").select("path")),
        outcomes.unionByName(
            folded.filter("row = 'request'").select("seq", "op", "path", "outcome", "replaced")
        ),
    )


# --- batches ---------------------------------------------------------------------


def plan_changes(files: DataFrame, requests: DataFrame) -> Changes:
    """Changes of a whole batch.

    A request whose path is above the path of another request is a barrier: the requests
    before it, the barrier itself, and those after it are separate blocks.  A batch without
    such pairs is one block.  Only the changes are carried from block to block; the files
    table is read, never rewritten, in between.
    """
    checked = validate(requests)
    above = checked.filter("code is null").select(F.explode(P.ancestors("path")).alias("path")).distinct()
    checked = durable(
        checked.join(above.withColumn("barrier", F.lit(True)), "path", "left").withColumn(
            "barrier", F.coalesce("barrier", F.lit(False))
        ),
        "requests",
    )
    valid = checked.filter("code is null").drop("code")
    outcomes = checked.filter("code is not null").select(
        "seq", "op", "path", F.col("code").alias("outcome"), F.lit(0).alias("replaced")
    )
    upserts = durable(files.select(*FILE_COLUMNS).limit(0), "upserts")
    removed = upserts.select("path")

    def run(block: DataFrame) -> None:
        nonlocal upserts, removed, outcomes
        if not block.limit(1).count():
            return
        change = _apply_block(overlay(files, upserts, removed), block.drop("barrier"))
        kept = without_subtrees(upserts, change.removed).join(
            change.upserts.select("path"), "path", "left_anti"
        )
        upserts = durable(kept.unionByName(change.upserts), "upserts")
        removed = durable(removed.unionByName(change.removed).distinct(), "removed")
        outcomes = outcomes.unionByName(change.outcomes)

    start = None
    while True:
        after = F.lit(True) if start is None else F.col("seq") > start
        barrier = valid.filter(after & F.col("barrier")).agg(F.min("seq")).first()[0]
        if barrier is None:
            run(valid.filter(after))
            return Changes(upserts, removed, outcomes)
        run(valid.filter(after & (F.col("seq") < barrier)))
        run(valid.filter(F.col("seq") == barrier))
        start = barrier


def apply(files: DataFrame, requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(new files, outcomes) of a batch of requests."""
    changes = plan_changes(files, requests)
    return overlay(files, changes.upserts, changes.removed), changes.outcomes


def changed_paths(files: DataFrame, changes: Changes) -> DataFrame:
    """(path, deleted): documents with another hash than before, and removed roots."""
    before = pick(files, changes.upserts).select("path", F.col("content_hash").alias("old_hash"))
    written = (
        changes.upserts.join(before, "path", "left")
        .filter(~F.col("content_hash").eqNullSafe(F.col("old_hash")))
        .select("path", F.lit(False).alias("deleted"))
    )
    return written.unionByName(changes.removed.select("path", F.lit(True).alias("deleted")))
