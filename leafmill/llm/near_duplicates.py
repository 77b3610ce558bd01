"""MinHash near-duplicates: one-permutation hashing, optimal densification, banded buckets, star edges.

A document's set holds the hashes of its distinct shingles.  One hash function splits the
hash range into bins; the smallest value of each bin is kept, and an empty bin takes the value
of the first filled bin in its own fixed random order.  Groups of bins form bands; equal bands put documents
into one bucket.

Equal sets collapse into one class first.  Inside a bucket nobody meets everybody: hubs meet the members that are
not in their component yet, the pairs are confirmed on the full sets, and components are joined.  The
first round's hub is the smallest id.  Then buckets that still hold several components draw a new
hub in every round; those of at most 16 members compare all of them
once.  Rounds go on, four at least, until one brings no link.

What is open then is finished exactly.  The shingles of every member of an open bucket are put in one order, rare ones
first.  Two sets that reach the share have their first common shingle so early in both that the rest of either is
still long enough; all pairs of different components that share such a shingle are confirmed.  The order
follows counts of hashed shingles: it decides how many pairs are met, never which links are found.
So a link is lost only if the documents share no bucket (below 1e-8 at the threshold).

Defined results: null and empty texts (or texts without words) have an empty set and form a
component of their own.  Rows that share a ``doc_id`` and differ in the text are one member with several sets: what is near to one of
them is in its component.  A row without ``doc_id`` has a null component and is kept.  Repeated
rows give repeated, equal results.  Columns other than the two named ones are not looked at.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import broadcast_if_small, durable, forget
from .common import query, rows_of, table, text_steps
from .quality import without

WIDTH = 5
BANDS = 32
ROWS = 5
BINS = BANDS * ROWS
#: A link needs 100 * intersection >= SHARE * union.
SHARE = 85
#: Rounds at least, hubs that a bucket draws in each round after the first, and the size up to which an open
#: bucket compares all its members.
LEAST_ROUNDS = 4
DRAWS = 1
SMALL = 16

#: Bytes of text whose shingles a task hashes at once; the arrays of a step take about 50 times that.
STEP = 1 << 17

_MASK = (1 << 64) - 1
_BASE = 0x9E3779B97F4A7C15
_random = np.random.Generator(np.random.PCG64(20240611))
_BYTE = _random.integers(1, 1 << 63, 256, dtype=np.uint64)
for _upper in range(65, 91):
    _BYTE[_upper] = _BYTE[_upper + 32]
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_PLACE = _random.integers(1, 1 << 63, max(WIDTH, ROWS) + 2, dtype=np.uint64) | np.uint64(1)
_BAND = _random.integers(1, 1 << 63, BANDS, dtype=np.uint64)
_EDGES = np.array([-(-(i << 64) // BINS) for i in range(1, BINS)], dtype=np.uint64)
#: Every bin probes all bins in an order of its own.
_PROBES = np.argsort(_random.random((BINS, BINS)), axis=1)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads all bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Powers:
    """Powers of the base and of its inverse, grown when a longer text comes."""

    def __init__(self):
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def reach(self, n: int) -> None:
        if len(self.up) < n:
            size = max(n, 2 * len(self.up))
            inverse = pow(_BASE, -1, 1 << 64)
            self.up = np.cumprod(np.r_[np.uint64(1), np.full(size - 1, _BASE, dtype=np.uint64)], dtype=np.uint64)
            self.down = np.cumprod(np.r_[np.uint64(1), np.full(size - 1, inverse, dtype=np.uint64)], dtype=np.uint64)


def shingle_sets(texts: list[bytes], powers: Powers) -> list[np.ndarray]:
    """The sorted set of shingle hashes of every text."""
    joined = np.frombuffer(b"\n".join(texts) + b"\n", dtype=np.uint8)
    space = _SPACE[joined]
    word = np.flatnonzero(space[:-1] & ~space[1:]) + 1
    if not space[0]:
        word = np.r_[0, word]
    end = np.flatnonzero(~space[:-1] & space[1:]) + 1
    powers.reach(len(joined))
    sums = np.zeros(len(joined) + 1, dtype=np.uint64)
    np.cumsum(_BYTE[joined] * powers.up[: len(joined)], out=sums[1:])
    words = mix((sums[end] - sums[word]) * powers.down[word] + (end - word).astype(np.uint64))
    text_end = np.cumsum([len(t) + 1 for t in texts])
    upto = np.searchsorted(word, text_end)
    spots = [words[j:] * _PLACE[j] for j in range(WIDTH)]
    count = max(0, len(words) - WIDTH + 1)
    runs = spots[0][:count].copy()
    for j in range(1, WIDTH):
        runs += spots[j][:count]
    runs = mix(runs)
    out, at = [], 0
    for stop in upto:
        if stop - at >= WIDTH:
            out.append(np.unique(runs[at : stop - WIDTH + 1]))
        elif stop > at:
            n = stop - at
            short = np.r_[words[at:stop], np.uint64(n)] * _PLACE[np.r_[:n, WIDTH]]
            out.append(mix(short.sum(keepdims=True, dtype=np.uint64)))
        else:
            out.append(np.empty(0, dtype=np.uint64))
        at = stop
    return out


def signature(values: np.ndarray) -> np.ndarray:
    """The smallest value of every bin of a sorted, non-empty set; empty bins take another bin's."""
    first = np.r_[0, np.searchsorted(values, _EDGES)]
    filled = np.diff(np.r_[first, len(values)]) > 0
    out = values[np.minimum(first, len(values) - 1)]
    if not filled.all():
        empty = np.flatnonzero(~filled)
        probes = _PROBES[empty]
        out[empty] = out[probes[np.arange(len(empty)), filled[probes].argmax(axis=1)]]
    return out


def band_keys(signatures: np.ndarray) -> np.ndarray:
    """One key per band of every signature; the band's number is part of the key."""
    parts = signatures.reshape(-1, BANDS, ROWS)
    return mix((mix(parts) * _PLACE[:ROWS]).sum(axis=2, dtype=np.uint64) + _BAND)


SIGNED = pa.schema(
    [("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("set_a", pa.int64()), ("set_b", pa.int64()),
     ("bands", pa.list_(pa.int64()))]
)
SETS = pa.schema([("rep", pa.int64()), ("shingles", pa.list_(pa.int64()))])
FRONTS = pa.schema([("rep", pa.int64()), ("size", pa.int64()), ("front", pa.list_(pa.int64()))])
SLOTS = pa.schema([("slot", pa.int64()), ("n", pa.int64())])
#: Counts of shingles by their lowest bits: 4 MB, whatever the number of documents.
COUNTED = 1 << 20
#: Links up to this number are joined into components by one task.
FEW_LINKS = 200_000


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    powers = Powers()
    for rows, texts in text_steps(batches, STEP):
        sets = shingle_sets(texts, powers)
        full = [i for i, s in enumerate(sets) if len(s)]
        keys = [[]] * len(sets)
        if full:
            for i, k in zip(full, band_keys(np.array([signature(sets[i]) for i in full])).view(np.int64), strict=True):
                keys[i] = k
        sums = [
            np.array([[mix(s ^ np.uint64(c)).sum(dtype=np.uint64) for s in sets]], dtype=np.uint64).view(np.int64)[0]
            for c in (0x5851F42D4C957F2D, 0x14057B7EF767814F)
        ]
        yield rows_of(SIGNED, rows.column(0).cast(pa.int64()), [len(s) for s in sets], *sums, keys)


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    powers = Powers()
    for rows, texts in text_steps(batches, STEP):
        sets = [s.view(np.int64) for s in shingle_sets(texts, powers)]
        yield rows_of(SETS, rows.column(0).cast(pa.int64()), sets)


def _slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = np.zeros(COUNTED, dtype=np.int64)
    for batch in batches:
        values = batch.column(0).flatten().to_numpy(zero_copy_only=False)
        counts += np.bincount(values & (COUNTED - 1), minlength=COUNTED)
    slots = np.flatnonzero(counts)
    yield rows_of(SLOTS, slots, counts[slots])


def least_common(size: int, share: int) -> int:
    """Shingles that a set has to have in common with one at least as large to reach the share."""
    return -(-size * share // 100)


def fronts(sets: DataFrame, share: int) -> DataFrame:
    """(rep, size, front): the rare shingles of every set, rarest first, one of which any set that reaches the share holds."""
    spark = sets.sparkSession
    slots = sets.select("shingles").mapInArrow(_slots, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(COUNTED, dtype=np.int32)
    counts[slots.column("slot").to_numpy()] = np.minimum(slots.column("n").to_numpy(), np.iinfo(np.int32).max)
    shared = spark.sparkContext.broadcast(counts)

    def front(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, out = [], []
            for values in batch.column(1):
                values = values.values.to_numpy(zero_copy_only=False)
                order = np.lexsort((values, shared.value[values & (COUNTED - 1)]))
                sizes.append(len(values))
                out.append(values[order[: len(values) - least_common(len(values), share) + 1]])
            yield rows_of(FRONTS, batch.column(0), sizes, out)

    return sets.select("rep", "shingles").mapInArrow(front, "rep long, size long, front array<long>")


def rest_of_pairs(members: DataFrame, sets: DataFrame, share: int) -> DataFrame:
    """(a, b): all pairs of ``members`` (rep, comp) in different components that can reach the share."""
    members = durable(members.distinct(), "unfinished")
    wanted = broadcast_if_small(members.select("rep"))
    rare = durable(fronts(sets.join(wanted, "rep", "left_semi"), share).join(members, "rep"), "fronts")
    each = rare.select("rep", "comp", "size", F.posexplode("front").alias("at", "s"))
    x, y = each.alias("x"), each.alias("y")
    total = F.col("x.size") + F.col("y.size")
    # the smaller set comes first; what follows the common shingle has to suffice in both
    rest = F.least(F.col("x.size") - F.col("x.at"), F.col("y.size") - F.col("y.at"))
    met = (
        (F.col("x.s") == F.col("y.s"))
        & (F.col("x.comp") != F.col("y.comp"))
        & (F.struct("x.size", "x.rep") < F.struct("y.size", "y.rep"))
        & (F.col("x.size") * 100 >= F.col("y.size") * share)
        & (rest * (100 + share) >= total * share)
    )
    first = x.filter((F.col("size") - F.col("at")) * (100 + share) >= F.col("size") * 2 * share)
    pairs = first.join(y, met)
    return pairs.select(F.least("x.rep", "y.rep").alias("a"), F.greatest("x.rep", "y.rep").alias("b")).distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of the links (a, b): root is the smallest node reachable.

    Alternates the two star steps: every node hands its larger, then its smaller neighbours to
    the smallest node it knows, until the edges are stars.  A node with many neighbours is met
    by a partial minimum and by a join whose large partitions can be split.  Up to ``FEW_LINKS``
    links, counted first, one task does the same steps without shuffles.
    """
    few = links.count() <= FEW_LINKS
    edges = links.select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")).filter("u < v")
    edges = durable((edges.coalesce(1) if few else edges).distinct(), "edges")
    before = None
    while True:
        for larger in (True, False):
            written = edges
            edges = written.coalesce(1) if few else written
            both = edges.union(edges.select(F.col("u").alias("v"), F.col("v").alias("u"))) if larger else edges
            both = both.coalesce(1) if few else both
            least = durable(both.groupBy("v").agg(F.min("u").alias("m")).select("v", F.least("v", "m").alias("m")), "least")
            met = both.join(least.coalesce(1) if few else least, "v")
            if larger:
                new = met.filter("u > v").select(F.col("u").alias("v"), F.col("m").alias("u"))
            else:
                ends = F.explode(F.array("u", "v")).alias("v")
                new = met.select(ends, F.col("m").alias("u"))
            following = durable(new.filter("u < v").distinct(), "edges")
            forget(written, least)
            edges = following
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))).first()
        if state == before:
            return edges.select(F.col("v").alias("node"), F.col("u").alias("root"))
        before = state


def near_duplicates(
    documents: DataFrame, share: int = SHARE, least_rounds: int = LEAST_ROUNDS, draws: int = DRAWS, small: int = SMALL
) -> DataFrame:
    """One row per row of ``documents``: doc_id, n_shingles, component_id, kept."""
    slim = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    signed = durable(slim.mapInArrow(_sign, "doc_id long, n_shingles long, set_a long, set_b long, bands array<long>"), "signed")
    known = signed.filter("n_shingles > 0 and doc_id is not null")
    classes = durable(known.groupBy("set_a", "set_b").agg(F.min("doc_id").alias("rep")), "classes")
    representatives = known.join(
        classes.select("set_a", "set_b", F.col("rep").alias("doc_id")), ["doc_id", "set_a", "set_b"]
    )
    rows = representatives.select(F.col("doc_id").alias("rep"), F.col("n_shingles").alias("size"), F.explode("bands").alias("key"))
    shared = durable(
        rows.groupBy("key").agg(F.min("rep").alias("low"), F.max("rep").alias("high")).filter("low < high").select("key"),
        "shared",
    )
    members = durable(rows.join(shared, "key"), "members")
    wanted = members.select("rep").distinct()
    sets = durable(
        slim.join(broadcast_if_small(wanted.withColumnRenamed("rep", "doc_id")), "doc_id").mapInArrow(
            _sets, "rep long, shingles array<long>"
        ),
        "sets",
    )
    forget(shared)
    links = tested = labels = None
    for number in itertools.count():
        rows = members.withColumn("comp", F.col("rep"))
        if labels is not None:
            rows = members.join(labels, members["rep"] == labels["node"], "left").select(
                "key", "rep", "size", F.coalesce("root", "rep").alias("comp")
            )
        # the first hub is the smallest id; later rounds draw some hubs anew for every bucket
        turns = [F.col("rep")] if number == 0 else [F.xxhash64("rep", "key", F.lit(number), F.lit(i)) for i in range(draws)]
        drawn = [F.min(F.struct(t.alias("turn"), "rep", "comp", "size")) for t in turns]
        hubs = durable(
            rows.groupBy("key")
            .agg(F.array(*drawn).alias("hubs"), F.count("*").alias("n"), F.min("comp").alias("c0"), F.max("comp").alias("c1"))
            .filter("c0 < c1")
            .select("key", "n", "hubs"),
            "hubs",
        )
        if not hubs.take(1):
            break
        rows = durable(rows.join(hubs.select("key", "n"), "key"), "open")
        few = (F.col("n") <= small) & F.lit(number == 1)
        met = rows.join(hubs.select("key", F.explode("hubs").alias("hub")), "key").filter(~few)
        met = met.select("rep", "size", "comp", F.col("hub.rep").alias("h"), F.col("hub.size").alias("hs"), F.col("hub.comp").alias("hc"))
        if number == 1:
            some = rows.filter(few)
            other = some.select("key", F.col("rep").alias("h"), F.col("size").alias("hs"), F.col("comp").alias("hc"))
            met = met.unionByName(some.join(other, "key").filter("rep < h").select("rep", "size", "comp", "h", "hs", "hc"))
        # sets of too different sizes cannot reach the share
        met = met.filter("comp <> hc").filter(F.least("size", "hs") * 100 >= F.greatest("size", "hs") * share)
        pairs = met.select(F.least("rep", "h").alias("a"), F.greatest("rep", "h").alias("b")).distinct()
        if tested is not None:
            pairs = pairs.join(tested, ["a", "b"], "left_anti")
        checked = durable(confirm(pairs, sets, share), "checked")
        tested = checked.select("a", "b") if tested is None else tested.union(checked.select("a", "b"))
        found = checked.filter("linked").select("a", "b")
        new = bool(found.take(1))
        if new:
            links = found if links is None else links.union(found)
            labels = components(links)
        forget(hubs)
        # small buckets have compared all their members in the second round
        rows = rows.filter(F.col("n") > small) if number else rows
        members = rows.select("key", "rep", "size")
        if not new and number >= least_rounds - 1:
            pairs = rest_of_pairs(rows.select("rep", "comp"), sets, share)
            checked = durable(confirm(pairs.join(tested, ["a", "b"], "left_anti"), sets, share), "checked")
            found = checked.filter("linked").select("a", "b")
            if found.take(1):
                labels = components(found if links is None else links.union(found))
            break
    forget(sets)
    out = signed.select("doc_id", "n_shingles", "set_a", "set_b").join(classes, ["set_a", "set_b"], "left")
    root = F.col("rep")
    if labels is not None:
        out = out.join(labels, out["rep"] == labels["node"], "left")
        root = F.coalesce("root", "rep")
    component = F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), root).otherwise(F.col("doc_id"))
    out = out.select("doc_id", "n_shingles", component.alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def one_of_each(documents: DataFrame, share: int = SHARE) -> DataFrame:
    """One document per component, the one with the smallest id, all columns as they are.

    Of rows that share id and text one stays; other texts of an id that stays all stay, and rows without id stay.
    """
    gone = durable(near_duplicates(documents, share).filter("not kept").select("doc_id").distinct(), "gone")
    left = without(documents, gone)
    twice = durable(left.groupBy("doc_id").count().filter("count > 1 and doc_id is not null").select("doc_id"), "twice")
    if not twice.take(1):
        return left
    again = left.join(twice, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])
    return without(left, twice).unionByName(again.select(*left.columns))


def confirm(pairs: DataFrame, sets: DataFrame, share: int) -> DataFrame:
    """(a, b, linked) of the pairs, decided on the full sets."""
    left = sets.select(F.col("rep").alias("a"), F.col("shingles").alias("sa"))
    right = sets.select(F.col("rep").alias("b"), F.col("shingles").alias("sb"))
    both = pairs.join(left, "a").join(right, "b")
    common = F.size(F.array_intersect("sa", "sb"))
    linked = common * 100 >= (F.size("sa") + F.size("sb") - common) * share
    return both.select("a", "b", linked.alias("linked"))


OP1_SQL = r"""
WITH RECURSIVE tokens AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS w FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' '))
                                      WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM tokens),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
common AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM shingles x JOIN shingles y ON x.s = y.s AND x.doc_id <> y.doc_id
  GROUP BY ALL),
links AS (
  SELECT a, b FROM common JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b WHERE 100 * k >= 85 * (p.n + q.n - k)),
reach AS (
  SELECT doc_id, doc_id AS other FROM documents UNION SELECT r.doc_id, l.b FROM reach r JOIN links l ON l.a = r.other)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, r.component_id, d.doc_id = r.component_id AS kept
FROM documents d LEFT JOIN sizes USING (doc_id)
JOIN (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id) r USING (doc_id)
"""


@query("op1_minhash_near_duplicates", OP1_SQL)
def op1_minhash_near_duplicates(spark, folder):
    return near_duplicates(table(spark, folder, "documents"))
