"""The node set of a corpus, and the listing operators on it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import paths as P
from ..session import broadcast_if_small
from .errors import InvalidParameter, NotDirectory, NotFound

SORT_FIELDS = ("name", "size", "mtime")


# --- node sets -------------------------------------------------------------------


def directories(files: DataFrame) -> DataFrame:
    """Distinct directories above the files, with their parent; the root always.

    A file adds its direct parent only; the distinct parents, which are far fewer
    than the files, are then exploded into their ancestors.
    """
    root = files.sparkSession.createDataFrame([("/",)], "path string")
    direct = files.select(P.parent("path").alias("path")).distinct()
    above = direct.select(F.explode(P.ancestors("path", include_self=True)).alias("path"))
    return above.union(root).distinct().select("path", P.parent("path").alias("parent"))


def _file_nodes(files: DataFrame) -> DataFrame:
    hash_column = F.col("content_hash") if "content_hash" in files.columns else F.lit(None).cast("string")
    return files.select(
        "path",
        P.parent("path").alias("parent"),
        P.name("path").alias("name"),
        F.lit("file").alias("kind"),
        F.col("size").cast("bigint").alias("size"),
        "mtime",
        hash_column.alias("content_hash"),
    )


def _directory_nodes(dirs: DataFrame, mtime_type) -> DataFrame:
    return dirs.select(
        "path",
        P.parent("path").alias("parent"),
        P.name("path").alias("name"),
        F.lit("dir").alias("kind"),
        F.lit(0).cast("bigint").alias("size"),
        F.lit(None).cast(mtime_type).alias("mtime"),
        F.lit(None).cast("string").alias("content_hash"),
    )


def nodes(files: DataFrame) -> DataFrame:
    """Files together with all their directories."""
    return _file_nodes(files).unionByName(
        _directory_nodes(directories(files), files.schema["mtime"].dataType)
    )


def duplicate_paths(files: DataFrame) -> DataFrame:
    """Paths that occur more than once, and paths that are file and directory at once."""
    counts = files.groupBy("path").agg(F.count(F.lit(1)).alias("copies"))
    both = files.select("path").join(directories(files), "path", "left_semi").distinct()
    return (
        counts.filter("copies > 1")
        .select("path", F.lit("DUPLICATE").alias("problem"))
        .unionByName(both.select("path", F.lit("FILE_AND_DIR").alias("problem")))
    )


def nodes_from_rows(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, rejected) from explicit rows (pos, path, kind, size, mtime).

    The last row of a path wins, unknown kinds are rejected, and directories that no row
    names are added.
    """
    known = F.col("kind").isin("file", "dir")
    cleaned = rows.withColumn("path", P.clean("path")).filter("path <> '/'")
    rejected = cleaned.filter(~F.coalesce(known, F.lit(False))).withColumn(
        "reject_reason", F.lit("UNKNOWN_KIND")
    )
    latest = (
        cleaned.filter(known)
        .groupBy("path")
        .agg(F.max_by(F.struct("kind", "size", "mtime"), "pos").alias("row"))
        .select("path", "row.*")
    )
    explicit = latest.select(
        "path",
        P.parent("path").alias("parent"),
        P.name("path").alias("name"),
        "kind",
        F.col("size").cast("bigint").alias("size"),
        "mtime",
        F.lit(None).cast("string").alias("content_hash"),
    )
    implied = directories(latest).join(latest.select("path"), "path", "left_anti")
    return (
        explicit.unionByName(_directory_nodes(implied, rows.schema["mtime"].dataType)),
        rejected,
    )


def adjacency(tree: DataFrame) -> DataFrame:
    return tree.filter("path <> '/'").select("parent", F.col("path").alias("child"), "kind")


# --- requests --------------------------------------------------------------------


def stat(tree: DataFrame, requests: DataFrame) -> DataFrame:
    """Metadata of requested paths; requests keep all their columns."""
    wanted = requests.withColumn("path", P.clean("path"))
    return wanted.join(tree, "path", "left").withColumn(
        "status", F.when(F.col("kind").isNull(), F.lit("NOT_FOUND")).otherwise(F.lit("OK"))
    )


def directory_status(tree: DataFrame, requests: DataFrame) -> DataFrame:
    """Whether requested roots are directories: OK, NOT_DIR or NOT_FOUND."""
    return stat(tree, requests).select(
        *requests.columns,
        F.when(F.col("kind") == "dir", F.lit("OK"))
        .when(F.col("kind") == "file", F.lit("NOT_DIR"))
        .otherwise(F.lit("NOT_FOUND"))
        .alias("status"),
    )


def require_directory(rows: DataFrame, path: str) -> str:
    """Cleaned root of a single request, or the error of that request.

    ``rows`` is any table with a path column.  The check is one filtered scan that stops
    at the first row below the root.
    """
    root = normalise(path)
    if root == "/":
        return root
    if rows.filter(P.below("path", root)).limit(1).count():
        return root
    found = rows.filter(F.col("path") == root).limit(1)
    kind = found.select("kind").collect() if "kind" in rows.columns else None
    if kind and kind[0].kind == "dir":
        return root
    if kind or (kind is None and found.count()):
        raise NotDirectory(root)
    raise NotFound(root)


def normalise(path: str) -> str:
    """The driver-side twin of ``paths.clean`` for one literal argument."""
    kept: list[str] = []
    for part in path.split("/"):
        if part == "..":
            kept = kept[:-1]
        elif part not in ("", "."):
            kept.append(part)
    return "/" + "/".join(kept)


# --- order and paging ------------------------------------------------------------


def _sort_value(tree: DataFrame, field: str) -> Column:
    if field not in SORT_FIELDS:
        field = "name"
    if field == "mtime" and tree.schema["mtime"].dataType.typeName() == "string":
        # Times in RFC 3339 text compare as instants, other text compares as text.
        text = F.coalesce("mtime", F.lit(""))
        rfc3339 = text.rlike(r"\A\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d(\.\d+)?(Z|[+-]\d\d:\d\d)\z")
        instant = F.when(rfc3339, F.try_to_timestamp(text))
        return F.struct(instant.alias("instant"), F.when(instant.isNull(), text).alias("text"))
    return F.col(field)


def sort_order(tree: DataFrame, field: str = "name", reverse: bool = False) -> list[Column]:
    """Sort columns; equal values keep the pre-order in both directions."""
    value = _sort_value(tree, field)
    first = value.desc_nulls_last() if reverse else value.asc_nulls_first()
    return [first, P.preorder("path").asc()]


def page(ordered: DataFrame, limit: int = 0, offset: int = 0) -> DataFrame:
    """One page; a limit of zero means no limit."""
    if offset > 0:
        ordered = ordered.offset(offset)
    return ordered.limit(limit) if limit > 0 else ordered


def total(rows: DataFrame) -> DataFrame:
    """Number of rows before paging, from its own aggregate."""
    return rows.agg(F.count(F.lit(1)).alias("total"))


# --- listing ---------------------------------------------------------------------


def ls_rows(tree: DataFrame, path: str = "/", recursive: bool = False, show_all: bool = False) -> DataFrame:
    """The nodes that a listing shows, unordered."""
    root = require_directory(tree, path)
    rows = tree.filter(P.below("path", root) if recursive else (F.col("parent") == root))
    rows = rows.filter("path <> '/'")
    return rows if show_all else rows.filter(~P.hidden("path", root))


def ls(
    tree: DataFrame,
    path: str = "/",
    sort: str = "name",
    reverse: bool = False,
    recursive: bool = False,
    show_all: bool = False,
    limit: int = 0,
    offset: int = 0,
) -> DataFrame:
    rows = ls_rows(tree, path, recursive, show_all)
    return page(rows.orderBy(*sort_order(rows, sort, reverse)), limit, offset)


def tree_lines(
    tree: DataFrame,
    path: str = "/",
    depth: int = 0,
    show_all: bool = False,
    dirs_only: bool = False,
    full_path: bool = False,
    show_size: bool = False,
    sort: str = "name",
    dirs_first: bool = False,
) -> DataFrame:
    """Indented lines (sort_key, path, line) of a tree, ordered by ``sort_key``.

    A node sorts by the keys of all components between the root and itself.  Derived
    directories have no size and no time, so their keys follow from the path alone and no
    join with the ancestors is needed.
    """
    root = require_directory(tree, path)
    rows = tree.filter(P.below("path", root))
    if not show_all:
        rows = rows.filter(~P.hidden("path", root))
    if dirs_only:
        rows = rows.filter("kind = 'dir'")
    level = P.depth("path", root)
    if depth >= 0:
        rows = rows.filter(level <= depth)

    value = _sort_value(tree, sort)
    sort_type = tree.select(value.alias("value")).schema["value"].dataType
    by_name = sort not in ("size", "mtime")

    def key(is_file: Column, of_node: Column, node_name: Column) -> Column:
        group = is_file if dirs_first else F.lit(False)
        return F.struct(
            group.alias("is_file"),
            (node_name if by_name else of_node).alias("value"),
            node_name.alias("name"),
        )

    parts = F.split(P.relative("path", root), "/")
    of_directory = (F.lit(0) if sort == "size" else F.lit(None)).cast(sort_type)
    if sort == "mtime" and sort_type.typeName() == "struct":
        of_directory = F.struct(
            F.lit(None).cast("timestamp").alias("instant"), F.lit("").alias("text")
        )
    above = F.transform(
        F.slice(parts, F.lit(1), F.size(parts) - 1),
        lambda part: key(F.lit(False), of_directory, part),
    )
    own = key(F.col("kind") == "file", value, F.col("name"))
    label = F.col("path") if full_path else F.col("name")
    line = F.concat(
        F.repeat(F.lit("  "), level),
        label,
        F.when(F.col("kind") == "dir", F.lit("/"))
        .when(F.lit(show_size), F.concat(F.lit(" ["), F.col("size").cast("string"), F.lit("]")))
        .otherwise(F.lit("")),
    )
    body = rows.select(
        F.concat(above, F.array(own)).alias("sort_key"), "path", line.alias("line")
    )
    head_text = root if full_path or root == "/" else root.rsplit("/", 1)[1]
    head = tree.sparkSession.range(1).select(
        F.array().cast(body.schema["sort_key"].dataType).alias("sort_key"),
        F.lit(root).alias("path"),
        F.lit(head_text).alias("line"),
    )
    return body.unionByName(head).orderBy("sort_key")


def find_rows(
    tree: DataFrame,
    path: str = "/",
    name: str = "",
    kind: str = "",
    max_depth: int = 0,
    min_depth: int = 0,
    show_all: bool = False,
    iname: str = "",
) -> DataFrame:
    """Nodes below a root whose base name fits a shell pattern, unordered.

    ``iname`` ignores case and replaces ``name``.  ``kind`` is ``dir``, ``file`` (also
    when empty), or anything else for both.
    """
    from ..functions.patterns import PatternError, shell_name
    from ..functions.text import lower

    root = require_directory(tree, path)
    rows = tree.filter(P.below("path", root))
    if not show_all:
        rows = rows.filter(~P.hidden("path", root))
    if kind in ("dir", "file", ""):
        rows = rows.filter(F.col("kind") == (kind or "file"))
    level = P.depth("path", root)
    if max_depth > 0:
        rows = rows.filter(level <= max_depth)
    if min_depth > 0:
        rows = rows.filter(level >= min_depth)
    try:
        if iname:
            return rows.filter(lower("name").rlike(shell_name(iname.lower())))
        return rows.filter(F.col("name").rlike(shell_name(name)))
    except PatternError as problem:
        raise InvalidParameter(str(problem)) from problem


def find(tree: DataFrame, path: str = "/", limit: int = 0, offset: int = 0, **options) -> DataFrame:
    return page(find_rows(tree, path, **options).orderBy("path"), limit, offset)


def glob_rows(files: DataFrame, pattern: str) -> DataFrame:
    """Files (hidden ones too) whose whole path fits a glob, unordered."""
    from ..functions.patterns import PatternError, path_glob

    try:
        expression = path_glob(pattern)
    except PatternError as problem:
        raise InvalidParameter(str(problem)) from problem
    return files.filter(F.col("path").rlike(expression)).select(
        F.regexp_replace("path", r"\A/", "").alias("path"), "size", "mtime"
    )


def glob(files: DataFrame, pattern: str, limit: int = 0, offset: int = 0) -> DataFrame:
    return page(glob_rows(files, pattern).orderBy("path"), limit, offset)


# --- joins along the tree ----------------------------------------------------------


def ancestor_max(files: DataFrame, dirs: DataFrame, value: str) -> DataFrame:
    """(path, value): the largest value among the directories above each file.

    The files' ancestors are exploded and met by equality, so no prefix comparison of all
    pairs takes place; the small directory side is broadcast when its size allows.
    """
    above = files.select("path", F.explode(P.ancestors("path")).alias("dir"))
    side = broadcast_if_small(dirs.select(F.col("path").alias("dir"), value))
    return above.join(side, "dir").groupBy("path").agg(F.max(value).alias(value))


def inhabited(dirs: DataFrame, files: DataFrame) -> DataFrame:
    """Directory rows that still have a document below them."""
    return dirs.join(directories(files).select("path"), "path", "left_semi")
