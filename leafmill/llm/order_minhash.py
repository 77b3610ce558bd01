"""Order MinHash fingerprints: minimal occurrence-numbered k-mers, kept in text order, hashed as tuples.

A text is a row of units (words, cut after eight code points).  Two neighbouring units are a k-mer; equal k-mers
are numbered by occurrence, so every numbered k-mer is unique in its text.  Each of the
sketches has an order of its own on the hashes of numbered k-mers (an exclusive-or with the
sketch's seed) and a bit that splits them into two classes; it selects the smallest of each
class, and hashes the two in the order in which they stand in the text.  So a sketch of two
texts agrees only when both k-mers and their order agree.  The sketches' hashes, eight
hexadecimal digits each, form the fingerprint; the likeness of two fingerprints is the share of
equal sketches.

All orders are minima over exploded k-mers in one aggregation.  A k-mer's value is its ordered
hash (36 bits) and its place (27 bits) in one long number, so a minimum also knows where it was.

Defined results: null is the empty text; a text without units has the k-mer of nothing, one with a single unit
that unit's.  Repeated rows give repeated results.  The next document is the next greater ``doc_id``, after
the last the first; where that id is repeated, its smallest text and smallest fingerprint count.  A row without
``doc_id`` has no next document: its edited text only loses its end, its ``near_next`` is null.
Other columns are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import broadcast_if_small, durable
from .common import query, table

UNIT = r"[^\x20\x09-\x0D]{1,8}"
SKETCHES = 32
_PLACE_BITS = 27
_DIGITS = 8


def _seed(number: int) -> int:
    """Seeds whose leading bits differ, so that the sketches' orders look for different k-mers."""
    value = (number * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) % (1 << 64)
    return value - (1 << 64) if value >> 63 else value


def with_kmers(rows: DataFrame) -> DataFrame:
    """Add ``kmers``, an array of (h, i), to rows with ``text``: hash and place of every numbered k-mer."""
    rows = rows.withColumn("_units", F.regexp_extract_all("text", F.lit(UNIT), F.lit(0)))
    hashed = F.transform(
        F.sequence(F.lit(0), F.greatest(F.size("_units") - 2, F.lit(0))),
        lambda i: F.xxhash64(F.get("_units", i), F.get("_units", i + 1)),
    )
    rows = rows.withColumn("_hashes", hashed).drop("_units")
    repeated = F.size(F.array_distinct("_hashes")) < F.size("_hashes")
    # only a text with equal k-mers is sorted: runs of equal ones count their occurrences
    rows = rows.withColumn(
        "_sorted",
        F.when(repeated, F.sort_array(F.transform("_hashes", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))),
    )
    starts = F.filter(
        F.sequence(F.lit(0), F.size("_sorted") - 1),
        lambda j: (j == 0) | (F.get("_sorted", j)["h"] != F.get("_sorted", j - 1)["h"]),
    )
    rows = rows.withColumn("_starts", F.when(F.col("_sorted").isNotNull(), starts))
    lengths = F.zip_with(
        "_starts", F.slice("_starts", 2, F.greatest(F.size("_starts"), F.lit(1))), lambda a, b: F.coalesce(b, F.size("_sorted")) - a
    )
    occurrences = F.flatten(F.transform(lengths, lambda n: F.sequence(F.lit(0), n - 1)))
    numbered = F.zip_with(
        "_sorted", occurrences, lambda x, n: F.struct(F.xxhash64(x["h"], n).alias("h"), x["i"].alias("i"))
    )
    single = F.transform("_hashes", lambda h, i: F.struct(F.xxhash64(h, F.lit(0)).alias("h"), i.alias("i")))
    kmers = F.when(F.col("_sorted").isNotNull(), numbered).otherwise(single)
    return rows.withColumn("kmers", kmers).drop("_hashes", "_sorted", "_starts")


def sketch_columns(sketches: int) -> list[Column]:
    """Two minima per sketch over rows with ``h`` and ``i``."""
    out = []
    for j in range(sketches):
        ordered = F.shiftrightunsigned(F.col("h").bitwiseXOR(F.lit(_seed(j)).cast("long")), 64 - 36)
        value = F.shiftleft(ordered, _PLACE_BITS).bitwiseOR(F.col("i").cast("long"))
        one = F.col("h").bitwiseAND(F.lit(1 << (j % 28)).cast("long")) != 0
        out += [F.min(F.when(one, value)).alias(f"a{j}"), F.min(F.when(~one, value)).alias(f"b{j}")]
    return out


def fingerprint_of(sketches: int) -> Column:
    """The fingerprint from the minima."""
    parts = []
    for j in range(sketches):
        a, b = F.col(f"a{j}"), F.col(f"b{j}")
        place = F.lit((1 << _PLACE_BITS) - 1).cast("long")
        first = F.coalesce(a.bitwiseAND(place) < b.bitwiseAND(place), F.lit(True))
        ha, hb = F.shiftright(a, _PLACE_BITS), F.shiftright(b, _PLACE_BITS)
        pair = F.xxhash64(first, ha, hb)
        parts.append(F.lpad(F.hex(F.shiftrightunsigned(pair, 32)), _DIGITS, "0"))
    return F.lower(F.concat(*parts))


def likeness(a: Column, b: Column, sketches: int = SKETCHES) -> Column:
    """The share of equal sketches of two fingerprints."""
    equal = [
        (F.substring(a, 1 + _DIGITS * j, _DIGITS) == F.substring(b, 1 + _DIGITS * j, _DIGITS)).cast("double")
        for j in range(sketches)
    ]
    return sum(equal[1:], equal[0]) / sketches


def fingerprints(texts: DataFrame, keys: list[str], sketches: int = SKETCHES) -> DataFrame:
    """(keys, fingerprint, copies) of rows with ``text``; rows that are equal in the keys must be equal in the text."""
    rows = with_kmers(texts.select(*keys, "text")).select(*keys, F.explode_outer("kmers").alias("k"))
    rows = rows.select(*keys, F.col("k.h").alias("h"), F.col("k.i").alias("i"))
    copies = F.sum(F.when(F.col("i") == 0, 1).otherwise(0)).alias("copies")
    return rows.groupBy(*keys).agg(*sketch_columns(sketches), copies).select(
        *keys, fingerprint_of(sketches).alias("fingerprint"), "copies"
    )


def followers(documents: DataFrame) -> DataFrame:
    """(doc_id, next_id, n): the next greater id, after the last the first; n is the longest text of ``doc_id``.

    Ids are dealt into ranges; inside a range the next row follows, at its end the next range's first.
    """
    sizes = documents.filter("doc_id is not null").groupBy("doc_id").agg(F.max(F.length("text")).alias("n"))
    ranged = durable(sizes.repartitionByRange("doc_id").withColumn("part", F.spark_partition_id()), "ranged")
    firsts = ranged.groupBy("part").agg(F.min("doc_id").alias("first"))
    # one row per range
    order = Window.orderBy("part")
    firsts = firsts.select(
        "part", F.lead("first").over(order).alias("after"), F.min("first").over(Window.partitionBy()).alias("smallest")
    )
    inside = F.lead("doc_id").over(Window.partitionBy("part").orderBy("doc_id"))
    return ranged.withColumn("inside", inside).join(F.broadcast(firsts), "part").select(
        "doc_id", F.coalesce("inside", "after", "smallest").alias("next_id"), "n"
    )


def edited(texts: DataFrame, order: DataFrame) -> DataFrame:
    """(doc_id, text, edited) of rows with an id: the last quarter of every text gives way to the next document's first signs.

    Only first signs travel; the texts are dealt by ``doc_id`` once, for this join, and all that follows keeps to that deal.
    """
    wanted = order.select(F.col("next_id").alias("doc_id"), F.col("doc_id").alias("before"), F.floor(F.col("n") / 4).cast("int").alias("cut"))
    heads = (
        texts.join(broadcast_if_small(wanted, max_rows=2_000_000), "doc_id")
        .select(F.col("before").alias("doc_id"), F.expr("substring(text, 1, cut)").alias("head"))
        .groupBy("doc_id")
        .agg(F.min("head").alias("head"))
    )
    joined = texts.join(heads.hint("merge"), "doc_id", "left").withColumn("cut", F.floor(F.length("text") / 4).cast("int"))
    new = F.concat(F.expr("substring(text, 1, length(text) - cut)"), F.expr("substring(coalesce(head, ''), 1, cut)"))
    return joined.select("doc_id", "text", new.alias("edited"))


def both_fingerprints(pairs: DataFrame, sketches: int) -> DataFrame:
    """Per distinct row (doc_id, text, edited): n_chars, edited_sha256, both fingerprints, and its copies."""
    keys = ["doc_id", "same", "n_chars", "edited_sha256", "of"]
    both = pairs.select(
        "doc_id",
        F.xxhash64("text").alias("same"),
        F.length("text").cast("long").alias("n_chars"),
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        F.posexplode(F.array("text", "edited")).alias("of", "text"),
    )
    return (
        fingerprints(both, keys, sketches)
        .groupBy(*keys[:-1])
        .agg(
            F.max(F.when(F.col("of") == 0, F.col("fingerprint"))).alias("fingerprint"),
            F.max(F.when(F.col("of") == 1, F.col("fingerprint"))).alias("edited_fingerprint"),
            F.max("copies").alias("copies"),
        )
    )


def edited_likeness(documents: DataFrame, sketches: int = SKETCHES) -> DataFrame:
    """Per row of ``documents``: doc_id, n_chars, edited_sha256, both fingerprints and their likenesses."""
    texts = documents.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
    )
    order = durable(followers(texts), "followers")
    # rows without id have no next document and need no join
    alone = texts.filter("doc_id is null")
    cut = F.expr("substring(text, 1, length(text) - cast(floor(length(text) / 4) as int))")
    rows = durable(both_fingerprints(edited(texts.filter("doc_id is not null"), order), sketches), "fingerprints")
    if alone.take(1):
        rows = rows.unionByName(both_fingerprints(alone.withColumn("edited", cut), sketches))
    following = rows.groupBy(F.col("doc_id").alias("next_id")).agg(F.min("fingerprint").alias("next"))
    after = order.select("doc_id", "next_id").join(following, "next_id").select("doc_id", "next")
    return (
        rows.join(after, "doc_id", "left")
        .withColumn("copy", F.explode(F.expr("sequence(1, copies)")))
        .select(
            "doc_id",
            "n_chars",
            "edited_sha256",
            "fingerprint",
            "edited_fingerprint",
            likeness(F.col("fingerprint"), F.col("edited_fingerprint"), sketches).alias("near_edited"),
            likeness(F.col("fingerprint"), F.col("next"), sketches).alias("near_next"),
        )
    )


@query("op10_order_minhash")
def op10_order_minhash(spark, folder):
    return edited_likeness(table(spark, folder, "documents"))
