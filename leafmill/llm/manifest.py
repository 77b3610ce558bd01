"""Merkle manifest of a table: a tree of hashes per source, a tree over the sources, and persistent versions of it.

A leaf is the SHA-256 (lower-case hexadecimal text) of a row's fields.  Leaves of a source stand in order of
``doc_id``; every three neighbours become the hash of their joined digests, until one node, the
source's subroot, is left.  The subroots form a tree of the same kind, whose last node is the root.

The trees are built in aligned blocks of 3^6 nodes, one group of rows per block.  A block gives one node; the
nodes of all blocks are the rows of the next pass, so no group grows with the table.  On the way down every block
gets the path of its node from the pass above: the siblings at each level up to the root.

A changed leaf makes a version of the tree.  The trees are persistent: a version shares every node of the original
but the ancestors of its leaf, which are copied.  The copies inside the block come first, then, with the
path that the block was given, those of the passes above, up to the version's own root.

Defined results: a null field is ``-``, any other its number of UTF-8 bytes, ``:`` and its value, so null and empty texts
differ.  A null source is a source of its own, the first; rows without ``doc_id`` come first in their source and
are never tampered with.  Rows that share source and ``doc_id`` are ordered by their leaves; repeated rows
are leaves of their own.  A source of one row has its leaf as subroot, and a table of one source that subroot as root.
An empty table has no rows.  Very long texts are only hashed.  Columns other than the fields are not looked at.
"""

from __future__ import annotations

from collections.abc import Callable
from hashlib import sha256
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import durable, forget
from .common import query, table

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
ARITY = 3
#: Levels that one pass builds; a block has ARITY ** LEVELS nodes at most.
LEVELS = 6

PATH = pa.list_(pa.struct([("left", pa.string()), ("right", pa.string())]))
NODES = pa.schema([("tree", pa.string()), ("n", pa.int64()), ("idx", pa.int64()), ("node", pa.string())])
PATHS = pa.schema([("tree", pa.string()), ("idx", pa.int64()), ("path", PATH)])
PROOFS = pa.schema(
    [("doc_id", pa.int64()), ("leaf", pa.string()), ("subroot", pa.string()), ("root", pa.string()), ("proof", PATH),
     ("version", pa.list_(pa.string())), ("folded_root", pa.string())]
)
PATH_TYPE = "array<struct<left string, right string>>"


def leaf(fields: dict[str, Column]) -> Column:
    """The hash of a row's fields."""
    texts = [c.cast("string") for c in fields.values()]
    parts = [F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]
    return F.sha2(F.concat(*parts), 256)


def without_newlines(fields: dict[str, Column]) -> dict[str, Column]:
    """What tampering leaves of a row."""
    return fields | {"text": F.replace(fields["text"], F.lit("\n"), F.lit(""))}


def every_second(fields: dict[str, Column]) -> Column:
    """Whether a row is tampered with."""
    return F.crc32(fields["doc_id"].cast("string").cast("binary")) % 2 == 0


def join(nodes: list[str]) -> str:
    return sha256("".join(nodes).encode()).hexdigest()


def height(n: int) -> int:
    """Levels between ``n`` leaves and their root."""
    levels = 0
    while n > 1:
        n, levels = -(-n // ARITY), levels + 1
    return levels


def build(nodes: list[str], levels: int) -> list[list[str]]:
    """The nodes of a block, level by level, its lowest level first."""
    out = [nodes]
    for _ in range(levels):
        below = out[-1]
        out.append([join(below[i : i + ARITY]) for i in range(0, len(below), ARITY)])
    return out


def siblings(tree: list[list[str]], at: int) -> list[tuple[str, str]]:
    """(left, right) siblings, joined, of a node of the lowest level and its ancestors, below the block's node."""
    out = []
    for level in tree[:-1]:
        first = at - at % ARITY
        out.append(("".join(level[first:at]), "".join(level[at + 1 : first + ARITY])))
        at //= ARITY
    return out


def copied(node: str, path: list[tuple[str, str]]) -> list[str]:
    """The ancestors of a changed node, copied up to the root of its version."""
    out = []
    for left, right in path:
        node = sha256(f"{left}{node}{right}".encode()).hexdigest()
        out.append(node)
    return out


def paths_array(paths: list[list[tuple[str, str]]]) -> pa.Array:
    sides = [side for path in paths for side in path]
    both = pa.StructArray.from_arrays(
        [pa.array([s[i] for s in sides], type=pa.string()) for i in (0, 1)], fields=list(PATH.value_type)
    )
    return pa.ListArray.from_arrays(pa.array([0, *accumulate(map(len, paths))], type=pa.int32()), both, type=PATH)


def indexed(rows: DataFrame, *order: str) -> DataFrame:
    """Rows with ``idx``, their place in their ``tree`` by ``order``, and ``n``, the size of that tree.

    Rows are dealt into ranges and counted per range and tree; a place is the rows of earlier ranges plus the place
    inside the range, so a large tree is spread over many ranges.
    """
    keys = ["tree", *order]
    ranged = durable(rows.repartitionByRange(*keys).withColumn("part", F.spark_partition_id()), "ranged")
    counts = ranged.groupBy("tree", "part").agg(F.count("*").alias("own"))
    whole = Window.partitionBy("tree")
    counts = counts.select(
        "tree",
        "part",
        F.sum("own").over(whole).alias("n"),
        (F.sum("own").over(whole.orderBy("part")) - F.col("own")).alias("before"),
    )
    place = F.row_number().over(Window.partitionBy("tree", "part").orderBy(*order))
    out = ranged.withColumn("place", place).join(durable(counts, "counts"), ["tree", "part"])
    out = durable(out.withColumn("idx", F.col("before") + F.col("place") - 1).drop("part", "place", "before"), "indexed")
    forget(ranged)
    return out


def _blocks(nodes: DataFrame, levels: int) -> DataFrame:
    return nodes.withColumn("block", F.expr(f"idx div {ARITY**levels}"))


def _block_tree(rows: pa.Table, number: int, levels: int) -> list[list[str]]:
    """The tree of a block of pass ``number``; its rows are in order."""
    left = height(rows.column("n")[0].as_py()) - number * levels
    return build(rows.column("node").to_pylist(), max(0, min(levels, left)))


def _next_pass(nodes: DataFrame, number: int, levels: int) -> DataFrame:
    """The nodes of all blocks of pass ``number``."""

    def one(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("idx")
        first = rows.slice(0, 1).to_pylist()[0]
        top = _block_tree(rows, number, levels)[-1][0]
        return pa.table([[first["tree"]], [first["n"]], [first["idx"] // ARITY**levels], [top]], schema=NODES)

    blocks = _blocks(nodes.select("tree", "n", "idx", "node"), levels).groupBy("tree", "block")
    return blocks.applyInArrow(one, "tree string, n long, idx long, node string")


def upward(nodes: DataFrame, levels: int) -> list[DataFrame]:
    """The rows (tree, n, idx, node) of every pass; the last has one node per tree."""
    most = nodes.agg(F.max("n")).first()[0] or 0
    out = [nodes]
    while ARITY ** (levels * (len(out) - 1)) < most:
        out.append(durable(_next_pass(out[-1], len(out) - 1, levels), "nodes"))
    return out


def downward(passes: list[DataFrame], paths: DataFrame, until: int, levels: int) -> DataFrame:
    """(tree, idx, path) of the rows of pass ``until``, from the paths of the trees' last nodes."""
    for number in range(len(passes) - 2, until - 1, -1):
        paths = durable(given_paths(passes[number], paths, number, levels, _own_paths, f"tree string, idx long, path {PATH_TYPE}"), "paths")
    return paths


def given_paths(nodes: DataFrame, paths: DataFrame, number: int, levels: int, make: Callable, schema: str) -> DataFrame:
    """``make(rows, tree of the block, path of its node)`` for every block of the rows of pass ``number``."""

    def one(rows: pa.Table, path: pa.Table) -> pa.Table:
        rows = rows.sort_by("idx")
        above = [(side["left"], side["right"]) for side in path.column("path")[0].as_py()]
        return make(rows, _block_tree(rows, number, levels), above)

    left = _blocks(nodes, levels).groupBy("tree", "block")
    right = paths.withColumnRenamed("idx", "block").groupBy("tree", "block")
    return left.cogroup(right).applyInArrow(one, schema)


def _own_paths(rows: pa.Table, tree: list[list[str]], above: list) -> pa.Table:
    own = [siblings(tree, i) + above for i in range(rows.num_rows)]
    return pa.table([rows.column("tree"), rows.column("idx"), paths_array(own)], schema=PATHS)


def _proofs(rows: pa.Table, tree: list[list[str]], above: list) -> pa.Table:
    own = [siblings(tree, i) + above for i in range(rows.num_rows)]
    # all leaves of a block have the same ancestors above it
    up = [tree[-1][0], *copied(tree[-1][0], above)]
    subroot, root = up[height(rows.column("n")[0].as_py()) - len(tree) + 1], up[-1]
    versions, folded = [], []
    for path, node, changed in zip(own, rows.column("node").to_pylist(), rows.column("alt").to_pylist(), strict=True):
        version = copied(node if changed is None else changed, path)
        folded.append(version[-1] if version else node if changed is None else changed)
        versions.append(None if changed is None else version)
    n = rows.num_rows
    columns = [rows.column("doc_id"), rows.column("node"), pa.array([subroot] * n), pa.array([root] * n), paths_array(own),
               pa.array(versions, type=pa.list_(pa.string())), pa.array(folded, type=pa.string())]
    return pa.table(columns, schema=PROOFS)


def proofs(
    documents: DataFrame,
    tampered: Callable[[dict[str, Column]], Column] = every_second,
    change: Callable[[dict[str, Column]], dict[str, Column]] = without_newlines,
    levels: int = LEVELS,
) -> DataFrame:
    """One row per row of ``documents``: doc_id, leaf, subroot, root, proof (left and right siblings of every level up to the
    root), version (the ancestors that the version of a tampered leaf copies, null for others) and folded_root."""
    fields = {f: F.col(f) for f in FIELDS}
    leaves = documents.select(
        # the null source comes first
        F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit("")).alias("tree"),
        F.col("doc_id").cast("long").alias("doc_id"),
        leaf(fields).alias("node"),
        F.when(tampered(fields), leaf(change(fields))).alias("alt"),
    )
    nodes = indexed(durable(leaves, "leaves"), "doc_id", "node")
    passes = upward(nodes, levels)
    subroots = passes[-1].select(F.lit("").alias("tree"), F.col("tree").alias("name"), "node")
    sources = indexed(subroots, "name")
    upper = upward(sources, levels)
    # nothing is above the root
    none = upper[-1].select("tree", F.lit(0).cast("long").alias("idx"), F.array().cast(PATH_TYPE).alias("path"))
    above = downward(upper, none, 0, levels)
    # the path of a subroot is the path of its source's last node
    last = sources.select("idx", "name").join(above.select("idx", "path"), "idx")
    last = durable(last.select(F.col("name").alias("tree"), F.lit(0).cast("long").alias("idx"), "path"), "paths")
    paths = downward(passes, last, 1, levels)
    schema = f"doc_id long, leaf string, subroot string, root string, proof {PATH_TYPE}, version array<string>, folded_root string"
    return given_paths(nodes, paths, 0, levels, _proofs, schema)


OP12_SQL = r"""
WITH RECURSIVE crc AS (
  SELECT list(v ORDER BY i) AS t FROM (
    SELECT i, list_reduce(range(8), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i) AS v FROM range(256) r(i))),
marked AS (
  SELECT d.*, xor(list_reduce(list_transform(range(length(doc_id::VARCHAR)), lambda i: ascii(substr(doc_id::VARCHAR, i + 1, 1))::BIGINT),
                              lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295), 4294967295) % 2 = 0 AS tampered
  FROM documents d, crc),
hashed AS (
  SELECT doc_id, source,
         coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
           || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') AS fields,
         sha256(fields || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
         CASE WHEN tampered THEN sha256(fields || coalesce(strlen(replace(text, chr(10), '')) || ':' || replace(text, chr(10), ''), '-')) END AS alt
  FROM marked),
leaves AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx, count(*) OVER (PARTITION BY source) AS n,
         row_number() OVER () AS row_id FROM hashed),
up AS (
  SELECT 0 AS level, source, idx, n, leaf AS h FROM leaves
  UNION ALL
  SELECT level + 1, source, idx // 3, (n + 2) // 3, sha256(string_agg(h, '' ORDER BY idx)) FROM up WHERE n > 1
  GROUP BY level, source, idx // 3, n),
subroots AS (
  SELECT source, level AS height, h AS subroot, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS idx, count(*) OVER () AS n FROM up WHERE n = 1),
upper_levels AS (
  SELECT 0 AS level, idx, n, subroot AS h FROM subroots
  UNION ALL
  SELECT level + 1, idx // 3, (n + 2) // 3, sha256(string_agg(h, '' ORDER BY idx)) FROM upper_levels WHERE n > 1 GROUP BY level, idx // 3, n),
sides AS (
  SELECT l.row_id, u.level AS step,
         coalesce(string_agg(u.h, '' ORDER BY u.idx) FILTER (u.idx < l.idx // (3 ** u.level)::BIGINT), '') AS before,
         coalesce(string_agg(u.h, '' ORDER BY u.idx) FILTER (u.idx > l.idx // (3 ** u.level)::BIGINT), '') AS after
  FROM leaves l JOIN up u ON u.source IS NOT DISTINCT FROM l.source AND u.n > 1 AND u.idx // 3 = l.idx // (3 ** (u.level + 1))::BIGINT
  GROUP BY ALL
  UNION ALL
  SELECT l.row_id, s.height + u.level,
         coalesce(string_agg(u.h, '' ORDER BY u.idx) FILTER (u.idx < s.idx // (3 ** u.level)::BIGINT), ''),
         coalesce(string_agg(u.h, '' ORDER BY u.idx) FILTER (u.idx > s.idx // (3 ** u.level)::BIGINT), '')
  FROM leaves l JOIN subroots s ON s.source IS NOT DISTINCT FROM l.source
  JOIN upper_levels u ON u.n > 1 AND u.idx // 3 = s.idx // (3 ** (u.level + 1))::BIGINT GROUP BY l.row_id, s.height, s.idx, u.level),
fold AS (
  SELECT row_id, 0 AS step, coalesce(alt, leaf) AS h FROM leaves
  UNION ALL
  SELECT f.row_id, f.step + 1, sha256(before || h || after) FROM fold f JOIN sides s ON s.row_id = f.row_id AND s.step = f.step),
proof AS (SELECT row_id, sha256(string_agg(before || after, '' ORDER BY step)) AS p FROM sides GROUP BY row_id)
SELECT l.doc_id, l.leaf, s.subroot, r.h AS root, coalesce(p.p, sha256('')) AS proof_sha256, f.h AS folded_root, f.h = r.h AS verified
FROM leaves l JOIN subroots s ON s.source IS NOT DISTINCT FROM l.source
JOIN (SELECT row_id, max_by(h, step) AS h FROM fold GROUP BY row_id) f USING (row_id)
LEFT JOIN proof p USING (row_id), (SELECT h FROM upper_levels WHERE n = 1) r
"""


@query("op12_merkle_manifest", OP12_SQL)
def op12_merkle_manifest(spark, folder):
    rows = proofs(table(spark, folder, "documents"))
    joined = F.array_join(F.transform("proof", lambda side: F.concat(side["left"], side["right"])), "")
    return rows.select(
        "doc_id", "leaf", "subroot", "root", F.sha2(joined, 256).alias("proof_sha256"), "folded_root",
        (F.col("folded_root") == F.col("root")).alias("verified"),
    )
