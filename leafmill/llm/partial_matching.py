"""Prediction by partial matching over the bytes of texts, trained on the corpus, as code length per document.

A text is read as its words (A-Z in lower case), each with an end after it, and an end of the text.  The model predicts
every one of these signs from up to ``order`` signs before it.  Contexts reach over words, so the order of words and
passages that other documents share change a text's code length; they end at the text's start.

The context trie is a table (context, sign, count) of all orders; a context is a number of nine
bits per sign, the newest last, so dropping the oldest sign is a bit mask.  A task counts the longest contexts of
its texts in sorted arrays and sends each once; the shorter ones are sums of these.  Escapes follow method
C: with N occurrences and d different signs, a sign with count n has n / (N + d) and the escape
d / (N + d).  After an escape the signs of the longer context are excluded from the shorter one's
N and d.  What no context knows is shared equally by the signs of the alphabet that are left.

Each different (context, sign) of the corpus is scored once, on Spark.  Documents sum up the scores of their places: from a broadcast
table up to ``most_grams`` rows, whose number is counted first.  Beyond that the texts are dealt into blocks; the different
grams of a block are joined with the scores, and each block meets its own scores.

The base's words meet the documents in two ways.  The most frequent words, bounded in number and in bytes, are
broadcast and summed up while the texts are read; the others are joined by word.

Defined results: null is the empty text, one end; a row without ``doc_id`` counts as training text.  Repeated
rows count and are scored one by one.  Long texts are read in windows that know the signs before them.  Other columns are not looked at.
"""

from __future__ import annotations

import itertools
import math
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import broadcast_if_small, durable, forget
from .common import query, rows_of, table, text_steps

ORDER = 5
BITS = 9
WORD_END, TEXT_END = 257, 258
ALPHABET = 258
#: Bounds of the broadcast words, and of the broadcast table of signs in context.
FREQUENT_WORDS, FREQUENT_BYTES = 200_000, 64
MOST_GRAMS = 4_000_000
_FLUSH = 300_000
#: Signs that are looked at together, different grams that a task holds and those not yet merged with them, bytes of a block of texts.
WINDOW, HELD_GRAMS, LOOSE_GRAMS, BLOCK_BYTES = 1 << 18, 2_000_000, 1_000_000, 8 << 20

_WORDS = pa.schema([("word", pa.binary()), ("c", pa.int64())])
_GRAMS = pa.schema([("gram", pa.int64()), ("n", pa.int64())])
_BLOCKS = pa.schema([("block", pa.int64()), ("row", pa.int64()), ("doc_id", pa.int64()), ("text", pa.binary())])
_PLACED = pa.schema([("block", pa.int64()), ("gram", pa.int64())])
_SCORED = pa.schema([("row", pa.int64()), ("score", pa.float64())])
_PARTS = pa.schema(
    [("row", pa.int64()), ("doc_id", pa.int64()), ("held_out", pa.bool_()), ("word", pa.binary()), ("n_tokens", pa.int64()),
     ("n_known", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())]
)

# A text's bytes as signs: blanks between words and the final line feed are the two ends.
_SIGNS = np.arange(1, 257, dtype=np.int64)
_SIGNS[ord(" ")], _SIGNS[ord("\n")] = WORD_END, TEXT_END


def held_out(doc_id: int | None) -> bool:
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 7 == 2


def words_of(text: bytes) -> list[bytes]:
    """The words of a text in lower case, and the empty word for its end."""
    return [*text.lower().split(), b""]


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: Counter[bytes] = Counter()
    for rows, texts in text_steps(batches):
        for doc_id, text in zip(rows.column(0).to_pylist(), texts, strict=True):
            if held_out(doc_id):
                counts.update(dict.fromkeys(words_of(text), 0))
            else:
                counts.update(words_of(text))
            if len(counts) >= _FLUSH:
                yield rows_of(_WORDS, list(counts), list(counts.values()))
                counts = Counter()
    if counts:
        yield rows_of(_WORDS, list(counts), list(counts.values()))


def vocabulary(documents: DataFrame) -> DataFrame:
    """(word, c): all words of all texts with their count in training texts; the empty word is the end."""
    rows = documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(_count_words, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


def windows(texts: list[bytes], order: int, window: int = WINDOW) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(number of the text, gram) for the signs of some texts: the context's signs and the sign, nine bits each."""
    marked = [b" ".join([b"", *text.lower().split(), b"\n"]) for text in texts]
    ends = np.cumsum([len(m) for m in marked], dtype=np.int64)
    starts = np.concatenate([[0], ends[:-1]])
    joined = np.frombuffer(b"".join(marked), dtype=np.uint8)
    upto = np.array([(1 << (BITS * (j + 1))) - 1 for j in range(order + 1)], dtype=np.int64)
    for low in range(0, len(joined), window):
        high = min(low + window, len(joined))
        signs = np.zeros(order + high - low, dtype=np.int64)
        head = max(0, low - order)
        signs[order - (low - head) :] = _SIGNS[joined[head:high]]
        gram = signs[order:].copy()
        for j in range(1, order + 1):
            gram |= signs[order - j : len(signs) - j] << (BITS * j)
        first, last = np.searchsorted(ends, [low, high - 1], side="right")
        inside = np.minimum(ends[first : last + 1], high) - np.maximum(starts[first : last + 1], low)
        text = np.repeat(np.arange(first, last + 1), inside)
        place = np.arange(low, high) - starts[text]
        early = np.flatnonzero(place < order)  # contexts end at the text's start
        gram[early] &= upto[place[early]]
        keep = place > 0
        yield text[keep], gram[keep]


def merged(codes: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Sums by code of several lists."""
    code, count = np.concatenate(codes), np.concatenate(counts)
    by = np.argsort(code, kind="stable")
    code, count = code[by], count[by]
    first = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]]))
    return code[first], np.add.reduceat(count, first)


def _count_grams(order: int, held: int = HELD_GRAMS, loose: int = LOOSE_GRAMS):
    loose = min(loose, held)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes: list[np.ndarray] = []
        counts: list[np.ndarray] = []
        size = whole = 0
        for rows, texts in text_steps(batches):
            unseen = [held_out(i) for i in rows.column(0).to_pylist()]
            for weight in (1, 0):  # grams of held-out texts are wanted, but weigh nothing
                some = [t for t, out in zip(texts, unseen, strict=True) if out != bool(weight)]
                for _, gram in windows(some, order):
                    code, n = np.unique(gram, return_counts=True)
                    codes.append(code)
                    counts.append(n * weight)
                    size += len(code)
                    if size - whole > loose:
                        code, n = merged(codes, counts)
                        codes, counts, size = [code], [n], len(code)
                        whole = size
                    if whole > held:
                        yield rows_of(_GRAMS, *codes, *counts)
                        codes, counts, size, whole = [], [], 0, 0
        if codes:
            yield rows_of(_GRAMS, *merged(codes, counts))

    return run


def context(gram: Column) -> Column:
    return F.shiftright(gram, BITS)


def shorter(ctx: Column, order: int) -> Column:
    """A context without its oldest sign."""
    out = F.lit(0).cast("long")
    for j in range(1, order):
        out = F.when(ctx >= 1 << (BITS * j), ctx.bitwiseAND(F.lit((1 << (BITS * j)) - 1).cast("long"))).otherwise(out)
    return out


class Model:
    """The trie as tables: ``signs`` (ctx, sign, n) of all orders, ``contexts`` (ctx, total, d, excluded).

    ``excluded`` is what the context's signs weigh in the context that is one sign shorter.
    """

    def __init__(self, counted: DataFrame, order: int):
        self.order = order
        mask = F.lit((1 << BITS) - 1).cast("long")
        top = counted.select(context(F.col("gram")).alias("ctx"), F.col("gram").bitwiseAND(mask).alias("sign"), "n")
        # the newest j signs of a context, for all j; what is longer than the context is the context again
        tails = [F.col("ctx").bitwiseAND(F.lit((1 << (BITS * j)) - 1).cast("long")) for j in range(order + 1)]
        every = F.array_distinct(F.array(*tails))
        self.signs = durable(
            top.select(F.explode(every).alias("ctx"), "sign", "n").groupBy("ctx", "sign").agg(F.sum("n").alias("n")), "signs"
        )
        below = self.signs.select(F.col("ctx").alias("short"), "sign", F.col("n").alias("m"))
        long = self.signs.filter("ctx > 0").withColumn("short", shorter(F.col("ctx"), order))
        excluded = long.join(below, ["short", "sign"]).groupBy("ctx").agg(F.sum("m").alias("excluded"))
        totals = self.signs.groupBy("ctx").agg(F.sum("n").alias("total"), F.count("*").alias("d"))
        self.contexts = durable(totals.join(excluded, "ctx", "left").fillna(0, ["excluded"]), "contexts")

    def scores(self, wanted: DataFrame) -> DataFrame:
        """(gram, score): log10 of the probability of each wanted gram's sign after its context."""
        mask = F.lit((1 << BITS) - 1).cast("long")
        zero = F.lit(0).cast("long")
        active = wanted.select(
            "gram", context(F.col("gram")).alias("ctx"), F.col("gram").bitwiseAND(mask).alias("sign"),
            F.lit(0.0).alias("score"), zero.alias("seen"), zero.alias("excluded"),
        )
        done = None
        for level in range(self.order + 1):
            keys = broadcast_if_small(active.select("ctx", "sign").distinct())
            counts = self.signs.join(keys, ["ctx", "sign"], "left_semi")
            known = self.contexts.join(broadcast_if_small(active.select("ctx").distinct()), "ctx", "left_semi").select(
                "ctx", "total", "d", F.col("excluded").alias("next_excluded")
            )
            met = durable(active.join(counts, ["ctx", "sign"], "left").join(known, "ctx", "left"), "met")
            d = F.col("d") - F.col("seen")
            weight = F.col("total") - F.col("excluded") + d
            found = met.filter("n is not null").select("gram", (F.col("score") + F.log10(F.col("n") / weight)).alias("score"))
            done = found if done is None else done.union(found)
            rest = met.filter("n is null")
            # an unknown context escapes for nothing, and so does one whose signs are all excluded
            escape = F.when(F.coalesce(d, F.lit(0)) > 0, F.log10(d / weight)).otherwise(0.0)
            rest = rest.select(
                "gram", "ctx", "sign", (F.col("score") + escape).alias("score"),
                F.coalesce("d", F.lit(0).cast("long")).alias("seen"),
                F.coalesce("next_excluded", F.lit(0).cast("long")).alias("excluded"),
            )
            # a context that is empty already has no shorter one
            left = rest.filter("ctx = 0").select("gram", (F.col("score") - F.log10(F.lit(ALPHABET) - F.col("seen"))).alias("score"))
            done = done.union(left)
            active = rest.filter("ctx > 0").withColumn("ctx", shorter(F.col("ctx"), self.order))
            if level < self.order and not active.take(1):
                break
        return done


def gram_scores(documents: DataFrame, order: int = ORDER) -> DataFrame:
    """(gram, score) of all signs in context of ``documents`` (doc_id, text), trained on those that are not held out."""
    if not 0 < order <= 6:
        raise ValueError("order: 1 to 6, for grams of 63 bits")
    seen = documents.mapInArrow(_count_grams(order), "gram long, n long")
    counted = durable(seen.groupBy("gram").agg(F.sum("n").alias("n")), "grams")
    model = Model(counted.filter("n > 0"), order)
    scores = durable(model.scores(counted.select("gram")), "scores")
    forget(counted, model.signs, model.contexts)
    return scores


class Lookup:
    """Scores by gram: grams sorted by a hash of some bits, the first one of each hash, and a search onwards from there."""

    def __init__(self, code: np.ndarray, score: np.ndarray):
        self.bits = max(1, int(len(code)).bit_length() + 1)
        slot = self._slot(code)
        by = np.argsort(slot, kind="stable")
        self.code, self.score = code[by], score[by]
        self.first = np.searchsorted(slot[by], np.arange(1 << self.bits)).astype(np.int32)

    def _slot(self, code: np.ndarray) -> np.ndarray:
        mixed = np.ascontiguousarray(code).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return (mixed >> np.uint64(64 - self.bits)).view(np.int64)

    def __call__(self, code: np.ndarray) -> np.ndarray:
        at = self.first[self._slot(code)]
        other = np.flatnonzero(self.code[at] != code)
        while len(other):
            at[other] += 1
            other = other[self.code[at[other]] != code[other]]
        return self.score[at]


def text_scores(texts: list[bytes], of: Lookup, order: int) -> np.ndarray:
    """The log10 probability of each text; all its grams are known to ``of``."""
    total = np.zeros(len(texts))
    for text, gram in windows(texts, order):
        if len(text):
            low = text[0]
            sums = np.bincount(text - low, weights=of(gram))
            total[low : low + len(sums)] += sums
    return total


def _block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, text) -> (block, row, doc_id, text): numbered rows in blocks of bounded size."""
    block = row = TaskContext.get().partitionId() << 33
    for rows, texts in text_steps(batches, BLOCK_BYTES):
        n = rows.num_rows
        yield rows_of(_BLOCKS, [block] * n, range(row, row + n), rows.column(0), texts)
        block, row = block + 1, row + n


def block_scores(blocks: DataFrame, scores: DataFrame, order: int) -> DataFrame:
    """(row, score) of numbered texts in blocks (block, row, text), for a table of scores of any size."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in text_steps(batches):
            block = rows.column(0).to_numpy()
            borders = [0, *np.flatnonzero(block[1:] != block[:-1]) + 1, len(block)]
            for low, high in itertools.pairwise(borders):
                for _, gram in windows(texts[low:high], order, WINDOW * 16):
                    code = np.unique(gram)
                    yield rows_of(_PLACED, np.full(len(code), block[low]), code)

    def score(texts: pa.Table, known: pa.Table) -> pa.Table:
        code, first = np.unique(known.column("gram").to_numpy(), return_index=True)
        of = Lookup(code, known.column("score").to_numpy()[first])
        sums = text_scores([t or b"" for t in texts.column("text").to_pylist()], of, order)
        return pa.table([texts.column("row"), pa.array(sums)], schema=_SCORED)

    placed = blocks.select("block", "text").mapInArrow(place, "block long, gram long")
    met = placed.join(scores, "gram").select("block", "gram", "score")
    return blocks.select("block", "row", "text").groupBy("block").cogroup(met.groupBy("block")).applyInArrow(
        score, "row long, score double"
    )


def frequent_words(words: DataFrame, most: int, longest: int = FREQUENT_BYTES) -> DataFrame:
    """The words of the highest frequency classes that hold at most ``most`` short words together.

    Sixteen classes per doubling; their sizes come from a count with a partial phase.
    """
    level = F.floor(F.log2(F.col("c") + 1) * 16)
    short = words.filter(F.octet_length("word") <= longest).withColumn("level", level)
    sizes = sorted(((r["level"], r["count"]) for r in short.groupBy("level").count().collect()), reverse=True)
    upto = itertools.accumulate(n for _, n in sizes)
    taken = [k for (k, _), n in zip(sizes, upto, strict=True) if n <= most]
    return short.filter(F.col("level") >= taken[-1]).drop("level") if taken else words.limit(0)


def score_documents(
    documents: DataFrame, order: int = ORDER, frequent: int = FREQUENT_WORDS, most_grams: int = MOST_GRAMS
) -> DataFrame:
    """Per row of ``documents``: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    spark = documents.sparkSession
    source = documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    counts = durable(vocabulary(documents), "counts")
    total, different = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count_if(F.col("c") > 0)).first()
    divisor = math.log10(total + different + 1)
    often = frequent_words(counts, frequent).toArrow()  # bounded by the number of words and their bytes
    known = spark.sparkContext.broadcast((often.column("word").to_pylist(), often.column("c").to_numpy()))
    del often
    scores = gram_scores(source, order)
    few = scores.limit(most_grams + 1).count() <= most_grams
    if few:
        rows = scores.toArrow()  # bounded by most_grams
        shared = spark.sparkContext.broadcast(Lookup(rows.column("gram").to_numpy(), rows.column("score").to_numpy()))
        del rows
    else:
        source = durable(source.mapInArrow(_block, "block long, row long, doc_id long, text binary"), "blocks")

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One row per document with the sums over frequent words, one row per other word of a document."""
        common, c = known.value
        of = dict(zip(common, zip((c > 0).astype(int).tolist(), (np.log10(c + 1) - divisor).tolist(), strict=True), strict=True))
        row = TaskContext.get().partitionId() << 33
        for rows, texts in text_steps(batches):
            out: list[list] = [[] for _ in _PARTS]
            numbers = range(row, row + len(texts)) if few else rows.column("row").to_pylist()
            sums = text_scores(texts, shared.value, order).tolist() if few else [0.0] * len(texts)
            row += len(texts)
            for at, doc_id, text, score in zip(numbers, rows.column("doc_id").to_pylist(), texts, sums, strict=True):
                n_known, base, others = 0, 0.0, []
                tokens = words_of(text)
                for word, k in Counter(tokens).items():
                    if (e := of.get(word)) is None:
                        others.append((word, k))
                    else:
                        n_known += k * e[0]
                        base += k * e[1]
                for column, value in zip(out, (at, doc_id, held_out(doc_id), None, len(tokens), n_known, base, score), strict=True):
                    column.append(value)
                n = len(others)
                for column, values in zip(
                    out, ([at] * n, [None] * n, [None] * n, [w for w, _ in others], [k for _, k in others], *[[None] * n] * 3), strict=True
                ):
                    column.extend(values)
            yield rows_of(_PARTS, *out)

    read = source.mapInArrow(
        parts, "row long, doc_id long, held_out boolean, word binary, n_tokens long, n_known long, base_score double, score double"
    )
    rows = durable(read, "parts")
    whole = rows.filter("word is null").drop("word")
    if not few:
        whole = whole.drop("score").join(block_scores(source, scores, order), "row")
    others = rows.filter("word is not null").select("row", "word", F.col("n_tokens").alias("k"))
    sums = others.join(counts, "word").groupBy("row").agg(
        F.sum(F.when(F.col("c") > 0, F.col("k"))).alias("more_known"),
        F.sum(F.col("k") * (F.log10(F.col("c") + 1) - divisor)).alias("more_base"),
    )
    return whole.join(sums, "row", "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_known") + F.coalesce("more_known", F.lit(0))).alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base_score") + F.coalesce("more_base", F.lit(0.0))).alias("base_score"),
        "score",
    )


@query("op9_partial_matching")
def op9_partial_matching(spark, folder):
    return score_documents(table(spark, folder, "documents"))
