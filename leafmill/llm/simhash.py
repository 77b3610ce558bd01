"""SimHash near-duplicates: segment bit counts, a grid range join under Manhattan distance, exact verification.

A fingerprint has a bit for every position that is set in more than half of the text's shingle hashes.  Equal
fingerprints collapse into one class first.  A fingerprint is cut into 32 segments of two bits; the bit counts of its segments are
its point.  One differing bit moves a point by at most one, so the Manhattan distance of two points is a lower
bound of the differing bits.

The segments form three groups.  Of a pair within four differing bits, two of the three groups together
differ by at most two.  So every point goes, for each of the three unions of two groups, into the cell of its own counts and
into all cells one step away: two points within distance two have such a cell in common.  Inside a cell
the distance of the whole points is tested, then the differing bits.

Counts are kept as thermometer codes (0, 1, 2 are 00, 01, 11), one word per point: a step flips one bit, and the
Manhattan distance is the number of differing bits of two codes.

Members of a cell never meet all at once.  Rounds pick one hub per cell, which meets the members of other
components; cells that still hold several components after the rounds are finished exactly: every member outside
the cell's largest component meets all members of other components, in blocks.  The rounds save work only; which
links are found does not depend on them.

Defined results: null and empty texts, and texts without words, have the fingerprint zero, which links like any other.
A row without ``doc_id`` has its fingerprint, a null component, and links nothing.  Repeated rows give
repeated, equal results; rows that share an id and differ in the text bring their classes together in that id only where
the fingerprints link.  Very long texts are read in steps.  Columns other than the two named ones are not looked at.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from ..session import durable, forget
from .common import query, rows_of, table, text_steps
from .near_duplicates import components

WIDTH = 4
SEED = 42
#: Fingerprints link at this number of differing bits or fewer; the grid is built for at most four.
LIMIT = 4
#: Rounds of hubs at most; what they leave open is finished exactly.
ROUNDS = 3
#: Members of a cell that one block of the exact finish holds.
BLOCK = 1000
#: Bytes of a text that are hashed in one step.
STEP = 1 << 20

_SEGMENTS = 32
_GROUPS = (range(0, 11), range(11, 22), range(22, _SEGMENTS))
_LOW = int("01" * _SEGMENTS, 2)
_HIGH = _LOW << 1
_SPACE = re.compile(rb"[\x20\x09-\x0D]")
#: Tells the three unions of two groups apart.
_UNION = (0x2545F4914F6CDD1D, 0x5851F42D4C957F2D, 0x14057B7EF767814F)

PRINTS = pa.schema([("doc_id", pa.int64()), ("print", pa.int64())])


def signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def steps(text: bytes) -> Iterator[list[bytes]]:
    """The lower-cased words of a text, about STEP bytes at a time."""
    at = 0
    while at < len(text):
        cut = _SPACE.search(text, at + STEP)
        end = cut.start() if cut else len(text)
        yield text[at:end].lower().split()
        at = end


def fingerprint(text: bytes) -> int:
    """The fingerprint of a text as a signed 64-bit number."""
    counts, total, tail = np.zeros(64, dtype=np.int64), 0, []
    for words in steps(text):
        words = tail + words
        if len(words) >= WIDTH:
            line = b" ".join(words)
            begin = [0, *accumulate(len(w) + 1 for w in words)]
            hashes = [xxh64_intdigest(line[a : b - 1], SEED) for a, b in zip(begin, begin[WIDTH:])]
            octets = np.array(hashes, dtype="<u8").view(np.uint8).reshape(-1, 8)
            counts += np.unpackbits(octets, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
            total += len(hashes)
            words = words[1 - WIDTH :]
        tail = words
    if not total and tail:
        octets = np.array([xxh64_intdigest(b" ".join(tail), SEED)], dtype="<u8").view(np.uint8)
        counts, total = np.unpackbits(octets, bitorder="little").astype(np.int64), 1
    return int(np.packbits(2 * counts > total, bitorder="little").view("<i8")[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows, texts in text_steps(batches):
        yield rows_of(PRINTS, rows.column(0).cast(pa.int64()), [fingerprint(t) for t in texts])


def fingerprints(documents: DataFrame) -> DataFrame:
    """(doc_id, print): one row per row of ``documents``."""
    slim = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return slim.mapInArrow(_fingerprints, "doc_id long, print long")


def word(value: int) -> Column:
    return F.lit(signed(value)).cast("long")


def point(print_: Column) -> Column:
    """The bit counts of a fingerprint's segments, as thermometer codes."""
    other = F.shiftrightunsigned(print_, 1)
    some, both = print_.bitwiseOR(other).bitwiseAND(word(_LOW)), print_.bitwiseAND(other).bitwiseAND(word(_LOW))
    return some.bitwiseOR(F.shiftleft(both, 1))


def cells(prints: DataFrame) -> DataFrame:
    """(print, cell): the cell of every point in each of the three unions, and the cells one step away."""
    moves = []
    for out, group in enumerate(_GROUPS):
        mask = sum(3 << 2 * s for s in range(_SEGMENTS) if s not in group)
        flips = [0, *(1 << bit for bit in range(2 * _SEGMENTS) if mask >> bit & 1)]
        moves += [F.struct(word(mask).alias("mask"), word(f).alias("flip"), word(f ^ _UNION[out]).alias("by")) for f in flips]
    # the lower bit of a code may flip while the upper one is clear, the upper one while the lower one is set
    may = F.bitwise_not(F.shiftrightunsigned("point", 1)).bitwiseAND(word(_LOW)).bitwiseOR(
        F.shiftleft("point", 1).bitwiseAND(word(_HIGH))
    )
    rows = prints.select("print", point(F.col("print")).alias("point"))
    rows = rows.select("print", "point", may.alias("may"), F.explode(F.array(*moves)).alias("m"))
    rows = rows.filter((F.col("m.flip") == 0) | (F.col("may").bitwiseAND(F.col("m.flip")) != 0))
    return rows.select("print", F.col("point").bitwiseAND(F.col("m.mask")).bitwiseXOR(F.col("m.by")).alias("cell"))


def near(a: Column, b: Column, limit: int) -> Column:
    """The lower bound, then the differing bits."""
    bound = F.bit_count(point(a).bitwiseXOR(point(b))) <= limit
    return bound & (F.bit_count(a.bitwiseXOR(b)) <= limit)


def with_component(members: DataFrame, labels: DataFrame | None) -> DataFrame:
    if labels is None:
        return members.withColumn("comp", F.col("print"))
    joined = members.join(labels, members["print"] == labels["node"], "left")
    return joined.select("cell", "print", F.coalesce("root", "print").alias("comp"))


def several(members: DataFrame) -> DataFrame:
    """The members (cell, comp, ...) of the cells that hold several components."""
    inside = Window.partitionBy("cell")
    rows = members.withColumn("c0", F.min("comp").over(inside)).withColumn("c1", F.max("comp").over(inside))
    return rows.filter("c0 < c1").drop("c0", "c1")


def rest(members: DataFrame, limit: int, block: int) -> DataFrame:
    """(a, b): every link between different components inside the cells of ``members`` (cell, print, comp), distinct."""
    inside = Window.partitionBy("cell")
    sized = members.withColumn("size", F.count(F.lit(1)).over(Window.partitionBy("cell", "comp")))
    # members outside the largest component are dealt into blocks; every block meets all members
    each = sized.select(
        *members.columns,
        F.max_by("comp", F.struct("size", "comp")).over(inside).alias("main"),
        F.ceil(F.count(F.lit(1)).over(inside) / block).cast("int").alias("blocks"),
    )
    x = each.filter("comp <> main").withColumn("block", F.pmod(F.hash("print"), F.col("blocks")))
    y = each.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    x, y = x.alias("x"), y.alias("y")
    met = (
        (F.col("x.cell") == F.col("y.cell"))
        & (F.col("x.block") == F.col("y.block"))
        & (F.col("x.comp") != F.col("y.comp"))
        & ((F.col("y.comp") == F.col("y.main")) | (F.col("x.print") < F.col("y.print")))
        & near(F.col("x.print"), F.col("y.print"), limit)
    )
    return x.join(y, met).select(F.col("x.print").alias("a"), F.col("y.print").alias("b")).distinct()


def print_components(prints: DataFrame, limit: int = LIMIT, rounds: int = ROUNDS, block: int = BLOCK) -> DataFrame | None:
    """(node, root) of the distinct, non-null fingerprints ``prints`` that have a link; None if there is no link."""
    if not 0 <= limit <= 4:
        raise ValueError("the grid is built for at most four differing bits")
    inside = Window.partitionBy("cell")
    members = cells(prints.select("print")).withColumn("low", F.min("print").over(inside)).withColumn("high", F.max("print").over(inside))
    members = durable(members.filter("low < high").select("cell", "print"), "members")
    links, labels, kept = [], None, [members]
    for number in range(rounds):
        rows = with_component(members, labels)
        turn = F.col("print") if number == 0 else F.xxhash64("print", "cell", F.lit(number))
        hub = F.min(F.struct(turn.alias("turn"), F.col("print").alias("hub"), F.col("comp").alias("hub_comp"))).over(inside)
        rows = several(rows.withColumn("h", hub)).select("cell", "print", "comp", "h.hub", "h.hub_comp")
        rows = durable(rows, "open")
        kept.append(rows)
        found = rows.filter("comp <> hub_comp").filter(near(F.col("print"), F.col("hub"), limit))
        found = durable(found.select(F.col("print").alias("a"), F.col("hub").alias("b")).distinct(), "links")
        members = rows.select("cell", "print")
        if not found.take(1):
            break
        links.append(found)
        labels = components(united(links))
    unfinished = durable(several(with_component(members, labels)), "unfinished")
    kept.append(unfinished)
    found = durable(rest(unfinished, limit, block), "links")
    if found.take(1):
        links.append(found)
        labels = components(united(links))
    forget(*kept, *links)
    return labels


def united(links: list[DataFrame]) -> DataFrame:
    out = links[0]
    for more in links[1:]:
        out = out.unionByName(more)
    return out


def simhash_duplicates(documents: DataFrame, limit: int = LIMIT, rounds: int = ROUNDS, block: int = BLOCK) -> DataFrame:
    """One row per row of ``documents``: doc_id, fingerprint (16 lower-case hexadecimal digits), component_id."""
    prints = durable(fingerprints(documents), "prints")
    classes = durable(
        prints.filter("doc_id is not null")
        .groupBy("print")
        .agg(F.min("doc_id").alias("rep"), F.max("doc_id").alias("last")),
        "classes",
    )
    labels = print_components(classes, limit, rounds, block)
    classes = classes.withColumn("root", F.col("print"))
    if labels is not None:
        classes = classes.drop("root").join(labels, classes["print"] == labels["node"], "left")
        classes = classes.select("print", "rep", "last", F.coalesce("root", "print").alias("root"))
    # a fingerprint of one document without a link needs no lookup
    linked = classes.groupBy("root").agg(F.min("rep").alias("component"), F.max("last").alias("last")).filter("component < last")
    linked = durable(classes.select("print", "root").join(linked.select("root", "component"), "root").select("print", "component"), "linked")
    out = prints.join(linked, "print", "left")
    return out.select(
        "doc_id",
        F.lpad(F.lower(F.hex("print")), 16, "0").alias("fingerprint"),
        F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id"),
    )


@query("op11_simhash_near_duplicates")
def op11_simhash_near_duplicates(spark, folder):
    return simhash_duplicates(table(spark, folder, "documents"))
