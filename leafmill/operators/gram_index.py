"""A stored index of character n-grams for substring search: levels of posting lists, merged when they are read.

A level holds the documents that one batch touched, in blocks of a few megabytes of text: ``postings`` (gram, block, n, docs),
one row per block and n-gram, by gram bucket; ``documents`` (block, paths); ``counts`` (gram, documents) and ``paths`` (all paths
that the batch touched, deleted ones too).  ``docs`` names places in the block's ``paths``: as 16-bit numbers, or as one bit per
document where that is shorter.  A posting is valid if no later level touched its path.  A level counts once its ``paths`` are
written, which happens last, so a batch that broke off is invisible and its repetition overwrites it.  ``compact`` writes the
valid postings as one level.

A search reads the posting lists of a term's rarest n-grams only, intersects them, and tests the contents of the documents
that are left; a term of at most three characters is its own n-gram and needs no test.

Documents without a word have no postings; an empty batch adds an empty level; repeated touched paths count once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..session import broadcast_if_small, durable, forget, pick
from .pattern_table import GRAM
from .search import (
    _BYTES_AT_ONCE, _COUNTS, _byte_tree, _numbered, _query_counts, _ranked_counts, _slices, _small_terms, _terms_in, rank_by_terms, search_terms,
)

BUCKETS = 64
#: Text and documents of one block.  2048 documents times the third power of all letters fit into a long number.
BLOCK_BYTES, BLOCK_DOCUMENTS = 4 << 20, 2048
#: Terms whose documents a task holds at once.
_TERMS_AT_ONCE = 1024
#: Characters of words; terms consist of them.
_SIGN = r"[\p{L}\p{Nd}\p{IsHan}]"
_NO_SIGNS = r"[^\p{L}\p{Nd}\p{IsHan}]+"
_POSTINGS, _DOCUMENTS = "gram string, block long, n int, docs binary", "block long, paths array<string>"
_ROWS = f"{_POSTINGS}, paths array<string>"
_MET = "path string, n int, held binary, terms array<int>, hits array<int>"
_ARROW_ROWS = pa.schema([("gram", pa.string()), ("block", pa.int64()), ("n", pa.int32()), ("docs", pa.binary()), ("paths", pa.list_(pa.string()))])
_ARROW_MET = pa.schema([("path", pa.string()), ("n", pa.int32()), ("held", pa.binary()), ("terms", pa.list_(pa.int32())), ("hits", pa.list_(pa.int32()))])
_EXPANDED = pa.schema([("gram", pa.string()), ("path", pa.string()), ("bucket", pa.int32())])


def word_grams(text: Column, length: int) -> Column:
    """Distinct n-grams inside the words of a lower-case text, in one pass over it."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(f"(?=({_SIGN}{{{length}}}))"), F.lit(1)))


def bucket_of(gram: Column | str) -> Column:
    return F.pmod(F.xxhash64(gram), F.lit(BUCKETS)).cast("int")


# --- blocks ------------------------------------------------------------------------


def _block_grams(words: list[str]) -> Iterator[tuple[list[str], np.ndarray, np.ndarray]]:
    """For each length: the n-grams of texts in which spaces stand for all that is not in words, how many texts
    hold each one, and these texts' places."""
    codes = np.frombuffer("\n".join(words).encode("utf-32-le"), dtype="<u4")
    seen = np.zeros(0x110000, dtype=bool)
    seen[codes] = True
    seen[:33] = False
    signs = np.flatnonzero(seen)
    number = np.zeros(0x110000, dtype=np.int32)
    number[signs] = np.arange(1, len(signs) + 1)
    base, many = len(signs) + 1, len(words)
    small = base**GRAM * many < 1 << 31
    sign = np.append(number[codes], np.zeros(GRAM, np.int32)).astype(np.int32 if small else np.int64, copy=False)
    document = np.cumsum(codes == 10, dtype=np.int32)
    # a key has up to three signs of one word, and zeros after the word's end
    inside = np.ones(len(codes), dtype=bool)
    key = np.zeros(len(codes), dtype=sign.dtype)
    for at in range(GRAM):
        ahead = sign[at : at + len(codes)]
        inside &= ahead > 0
        key = key * base + ahead * inside
    first = sign[: len(codes)] > 0
    pairs = _different(key[first] * many + document[first])
    for length in range(GRAM, 0, -1):
        key, document = pairs // many, pairs % many
        whole = key % base > 0
        yield _counted(key[whole], document[whole], base, length, signs)
        pairs = _different(key // base * many + document)


def _different(numbers: np.ndarray) -> np.ndarray:
    numbers = np.sort(numbers)
    return numbers[np.append(True, numbers[1:] != numbers[:-1])] if len(numbers) else numbers


def _counted(key: np.ndarray, document: np.ndarray, base: int, length: int, signs: np.ndarray) -> tuple[list[str], np.ndarray, np.ndarray]:
    starts = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, dtype=np.int64)
    keys = key[starts].astype(np.int64)
    codes = np.stack([signs[keys // base**at % base - 1] for at in reversed(range(length))], axis=1).astype("<u4")
    text = codes.tobytes().decode("utf-32-le")
    return [text[at : at + length] for at in range(0, len(text), length)], np.diff(np.append(starts, len(key))), document


def _packed(n: np.ndarray, numbers: np.ndarray, size: int, bytes_each: int = 2) -> pa.Array:
    """Lists of ``n`` different numbers below ``size``, each as numbers of some bytes or as one bit for every possible number."""
    width = -(-size // 8)
    short = bytes_each * n <= width
    lengths = np.where(short, bytes_each * n, width)
    starts = np.append(0, np.cumsum(lengths))
    data = np.zeros(starts[-1], dtype=np.uint8)
    row = np.repeat(np.arange(len(n)), n)
    places = np.repeat(starts[:-1], n)
    of_short, inside = short[row], np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    at, number = places[of_short] + bytes_each * inside[of_short], numbers[of_short]
    for byte in range(bytes_each):
        data[at + byte] = number >> 8 * byte & 255
    long = ~of_short
    np.bitwise_or.at(data, places[long] + (numbers[long] >> 3), (128 >> (numbers[long] & 7)).astype(np.uint8))
    return pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(starts.astype(np.int32)), pa.py_buffer(data)])


def _unpacked(n: np.ndarray, lists: list[bytes], size: int, bytes_each: int = 2) -> np.ndarray:
    """A row for each list, with a true value for each number that it has."""
    held, width = np.zeros((len(n), size), dtype=bool), -(-size // 8)
    rows = np.flatnonzero(bytes_each * n <= width)
    held[np.repeat(rows, n[rows]), np.frombuffer(b"".join(lists[i] for i in rows), f"<u{bytes_each}")] = True
    rows = np.flatnonzero(bytes_each * n > width)
    bits = np.frombuffer(b"".join(lists[i] for i in rows), np.uint8).reshape(len(rows), width)
    held[rows] = np.unpackbits(bits, axis=1, count=size)
    return held


def _block_rows(block: int, paths: pa.Array, lists: Iterator[tuple[list[str], np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
    """The rows of a block: its paths, and its posting lists."""
    one = pa.ListArray.from_arrays(pa.array([0, len(paths)], pa.int32()), paths)
    yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.string()), pa.array([block], pa.int64()), pa.nulls(1, pa.int32()), pa.nulls(1, pa.binary()), one], schema=_ARROW_ROWS)
    for grams, n, documents in lists:
        blocks = pa.array(np.full(len(n), block), pa.int64())
        columns = [pa.array(grams, pa.string()), blocks, pa.array(n, pa.int32()), _packed(n, documents, len(paths)), pa.nulls(len(n), _ARROW_ROWS.types[-1])]
        yield pa.RecordBatch.from_arrays(columns, schema=_ARROW_ROWS)


def _block_maker(bytes_of: int, documents_of: int):
    """A function for mapInArrow: from (path, words) to the rows of blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, paths, words, size = TaskContext.get().partitionId() << 32, [], [], 0
        for batch in batches:
            lengths = pc.fill_null(pc.binary_length(batch["words"]), 0).to_pylist()
            for path, text, length in zip(batch["path"], batch["words"], lengths):
                if words and (size + length > bytes_of or len(words) == documents_of):
                    yield from _block_rows(block, pa.array(paths, pa.string()), _block_grams(words))
                    block, paths, words, size = block + 1, [], [], 0
                paths.append(path.as_py())
                words.append(text.as_py() or "")
                size += length
        if words:
            yield from _block_rows(block, pa.array(paths, pa.string()), _block_grams(words))

    return run


def _blocks(files: DataFrame) -> DataFrame:
    """The rows of the blocks of documents: a task's documents in the order in which they come."""
    words = F.regexp_replace(X.lower("content"), _NO_SIGNS, " ")
    return files.select("path", words.alias("words")).mapInArrow(_block_maker(BLOCK_BYTES, BLOCK_DOCUMENTS), _ROWS)


def _expanded(postings: DataFrame, documents: DataFrame) -> DataFrame:
    """(gram, path, bucket) from posting lists and the documents (block, number, path) that count."""

    def paths_of(lists: pa.Table, rows: pa.Table) -> pa.Table:
        parts, (size, path) = [_EXPANDED.empty_table()], _places(rows)
        n, docs = lists["n"].to_numpy(), lists["docs"].to_pylist()
        for at in range(0, len(n) if size else 0, _TERMS_AT_ONCE):
            some = slice(at, at + _TERMS_AT_ONCE)
            row, number = np.nonzero(_unpacked(n[some], docs[some], size) & (path >= 0))
            picked = lists.select(["gram", "bucket"]).take(pa.array(row + at))
            parts.append(pa.table([picked["gram"], rows["path"].take(pa.array(path[number])), picked["bucket"]], schema=_EXPANDED))
        return pa.concat_tables(parts)

    return _cogrouped(postings, documents, paths_of, "gram string, path string, bucket int")


def _places(rows: pa.Table) -> tuple[int, np.ndarray]:
    """The documents of a block, and the row of each one in ``rows``, or -1."""
    size = rows["size"][0].as_py() if rows.num_rows else 0
    row = np.full(size, -1)
    row[rows["number"].to_numpy()] = np.arange(rows.num_rows)
    return size, row


def _cogrouped(postings: DataFrame, documents: DataFrame, meet, schema: str) -> DataFrame:
    """What ``meet`` makes of each block's posting lists and documents; a block is of a few megabytes."""
    return postings.groupBy("level", "block").cogroup(documents.groupBy("level", "block")).applyInArrow(meet, schema)


def _listed(documents: DataFrame) -> DataFrame:
    return documents.select("level", "block", F.size("paths").alias("size"), F.posexplode("paths").alias("number", "path"))


def document_grams(files: DataFrame) -> DataFrame:
    """(path, gram, bucket): the n-grams of one to three characters, each once per document."""
    low = files.select("path", X.lower("content").alias("low"))
    grams = low.select("path", F.explode(F.concat(*[word_grams(F.col("low"), n) for n in range(1, GRAM + 1)])).alias("gram"))
    return grams.withColumn("bucket", bucket_of("gram"))


# --- levels ------------------------------------------------------------------------


def _write_level(blocks: DataFrame, paths: DataFrame, folder: str, level: int) -> None:
    # written where they are made, so that the lists of a block and its paths are of one attempt of a task
    made = durable(blocks.withColumn("bucket", bucket_of("gram")), "blocks")
    lists = made.filter("gram IS NOT NULL").drop("paths")
    # ranges of (gram, block), so that a gram which all documents hold is spread over tasks in proportion
    ordered = lists.repartitionByRange("bucket", "gram", "block").sortWithinPartitions("bucket", "gram", "block")
    ordered.write.mode("overwrite").partitionBy("bucket").parquet(f"{folder}/postings/level={level}")
    counts = lists.groupBy("bucket", "gram").agg(F.sum("n").alias("n"))
    counts.write.mode("overwrite").parquet(f"{folder}/counts/level={level}")
    made.filter("gram IS NULL").select("block", "paths").write.mode("overwrite").parquet(f"{folder}/documents/level={level}")
    paths.select("path").distinct().write.mode("overwrite").parquet(f"{folder}/paths/level={level}")
    forget(made)


def _read(spark: SparkSession, folder: str, part: str, schema: str) -> DataFrame:
    return spark.read.schema(f"{schema}, level int").parquet(f"{folder}/{part}")


def levels(spark: SparkSession, folder: str) -> list[int]:
    """Levels that count: those whose paths were written to the end."""
    place = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/paths/level=*/_SUCCESS")
    found = place.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(place)
    return sorted(int(s.getPath().getParent().getName().removeprefix("level=")) for s in found or [])


def write_gram_index(files: DataFrame, folder: str) -> None:
    """Start an index: its first level holds all documents."""
    _write_level(_blocks(files), files, folder, 0)


def update_gram_index(files: DataFrame, touched: DataFrame, folder: str) -> int:
    """Add a level for ``touched`` (path); documents that are not in ``files`` any more are deleted."""
    level = max(levels(files.sparkSession, folder), default=-1) + 1
    paths = durable(touched.select("path").distinct(), "touched")
    _write_level(_blocks(pick(files, paths)), paths, folder, level)
    forget(paths)
    return level


def _postings(spark: SparkSession, folder: str) -> DataFrame:
    """(gram, block, n, docs, bucket, level) of all levels that count.  A bucket filter on it prunes the files."""
    return _read(spark, folder, "postings", f"{_POSTINGS}, bucket int").filter(F.col("level").isin(levels(spark, folder)))


def _live(spark: SparkSession, folder: str) -> DataFrame:
    """(level, block, size, number, path): the documents as of the last level, with their places in the blocks."""
    known = levels(spark, folder)
    documents = _listed(_read(spark, folder, "documents", _DOCUMENTS).filter(F.col("level").isin(known)))
    if len(known) <= 1:
        return documents
    # a path that no later level touched is not in this table
    later = _read(spark, folder, "paths", "path string").filter(F.col("level").isin(known[1:]))
    newest = later.groupBy("path").agg(F.max("level").alias("newest"))
    return (
        documents.join(broadcast_if_small(newest), "path", "left")
        .filter(F.col("newest").isNull() | (F.col("newest") == F.col("level")))
        .select(documents.columns)
    )


def valid_postings(spark: SparkSession, folder: str, buckets: list[int] | None = None) -> DataFrame:
    """(gram, path, bucket) as of the last level, of all buckets or some."""
    postings = _postings(spark, folder)
    return _expanded(postings if buckets is None else postings.filter(F.col("bucket").isin(buckets)), _live(spark, folder))


def compact(spark: SparkSession, folder: str, target: str) -> None:
    """Write the valid postings as the first level of a new index."""
    made = [0]  # blocks of a task

    def kept(lists: pa.Table, rows: pa.Table) -> pa.Table:
        size, path = _places(rows)
        if not size:
            return _ARROW_ROWS.empty_table()
        block, made[0] = (TaskContext.get().partitionId() << 32) + made[0], made[0] + 1
        still, n, docs, grams = np.flatnonzero(path >= 0), lists["n"].to_numpy(), lists["docs"].to_pylist(), lists["gram"]

        def parts() -> Iterator[tuple[list[str], np.ndarray, np.ndarray]]:
            for at in range(0, len(n), _TERMS_AT_ONCE):
                some = slice(at, at + _TERMS_AT_ONCE)
                held = _unpacked(n[some], docs[some], size)[:, still]
                many = held.sum(axis=1)
                yield grams.slice(at, _TERMS_AT_ONCE).filter(pa.array(many > 0)).to_pylist(), many[many > 0], np.nonzero(held)[1]

        paths = rows["path"].combine_chunks().take(pa.array(path[still]))
        return pa.Table.from_batches([*_block_rows(block, paths, parts())], schema=_ARROW_ROWS)

    live = _live(spark, folder)
    _write_level(_cogrouped(_postings(spark, folder), live, kept, _ROWS), live, target, 0)


# --- search ------------------------------------------------------------------------


def rarest_grams(spark: SparkSession, folder: str, terms: DataFrame, lists: int = 2) -> DataFrame:
    """(term, gram, bucket, lists): the n-grams of each term with the shortest lists.

    The counts include postings that are not valid any more, which changes the order at most.
    """
    own = F.when(F.length("term") <= GRAM, F.array("term")).otherwise(word_grams(F.col("term"), GRAM))
    grams = terms.select("term").distinct().select("term", F.explode(own).alias("gram")).withColumn("bucket", bucket_of("gram"))
    counts = _read(spark, folder, "counts", "bucket int, gram string, n long").filter(F.col("level").isin(levels(spark, folder)))
    counted = grams.join(counts.join(broadcast_if_small(grams.select("bucket", "gram").distinct()), ["bucket", "gram"])
                         .groupBy("bucket", "gram").agg(F.sum("n").alias("n")), ["bucket", "gram"], "left")
    # the rows of a window are the n-grams of one term
    order = Window.partitionBy("term").orderBy(F.coalesce("n", F.lit(0)), "gram")
    near = counted.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= lists)
    return near.select("term", "gram", "bucket", F.count(F.lit(1)).over(Window.partitionBy("term")).alias("lists"))


def holding(spark: SparkSession, folder: str, files: DataFrame, terms: DataFrame, lists: int = 2) -> DataFrame:
    """(path, term): documents that contain a term."""
    chosen = durable(rarest_grams(spark, folder, terms, lists), "grams")
    buckets = [r[0] for r in chosen.select("bucket").distinct().collect()]  # at most BUCKETS
    met = (
        valid_postings(spark, folder, buckets).join(broadcast_if_small(chosen), ["bucket", "gram"])
        .groupBy("path", "term")
        .agg(F.count(F.lit(1)).alias("n"), F.first("lists").alias("lists"))
        .filter("n = lists")
        .select("path", "term")
    )
    met = durable(met, "candidates")
    sure = met.filter(F.length("term") <= GRAM)
    # a document's list is no longer than the table of terms
    open_terms = met.filter(F.length("term") > GRAM).groupBy("path").agg(F.collect_list("term").alias("terms"))
    read = pick(files.select("path", "content"), open_terms).join(broadcast_if_small(open_terms), "path")
    low = read.select("path", "terms", X.lower("content").alias("low"))
    tested = low.select("path", F.explode(F.filter("terms", lambda t: F.contains(F.col("low"), t))).alias("term"))
    return sure.unionByName(tested)


def _block_meeter(chosen: np.ndarray):
    """A function for applyInArrow: from posting lists (slot, n, docs) and documents of a block to the terms that documents can have.

    ``chosen`` has the slots of each term's n-grams, filled up with -1.  A document whose path no other has comes with the packed terms
    all of whose n-grams it has, any other one with the terms of which it has n-grams, and how many.
    """
    wanted, slots = (chosen >= 0).sum(axis=1), int(chosen.max(initial=-1)) + 1

    def run(lists: pa.Table, rows: pa.Table) -> pa.Table:
        size, path = _places(rows)
        if not size or not lists.num_rows:
            return _ARROW_MET.empty_table()
        n, docs = lists["n"].to_numpy(), lists["docs"].to_pylist()
        row = np.full(slots + 1, -1)  # the last one is for terms without more n-grams
        row[lists["slot"].to_numpy()] = np.arange(len(n))
        alone = np.zeros(size, dtype=bool)
        alone[path >= 0] = rows["alone"].to_numpy()[path[path >= 0]]
        found, counts = [], []
        for at in range(0, len(chosen), _TERMS_AT_ONCE):
            mine = row[chosen[at : at + _TERMS_AT_ONCE]]
            used, place = np.unique(mine, return_inverse=True)
            held, have = np.zeros((len(used), size), dtype=bool), used >= 0
            held[have] = _unpacked(n[used[have]], [docs[i] for i in used[have]], size)
            hits = held[place.reshape(mine.shape)].sum(axis=1, dtype=np.int32) * (path >= 0)
            hits[:, alone] *= hits[:, alone] == wanted[at : at + _TERMS_AT_ONCE, None]
            document, term = np.nonzero(hits.T)
            found.append(document * len(chosen) + term + at)
            counts.append(hits[term, document])
        keys = np.concatenate(found)
        order = np.argsort(keys, kind="stable")
        keys, hits = keys[order], np.concatenate(counts)[order]
        document, term = keys // len(chosen), keys % len(chosen)
        many = np.bincount(document, minlength=size)
        one, other = np.flatnonzero(alone & (many > 0)), np.flatnonzero(~alone & (many > 0))
        of = lambda places: rows["path"].take(pa.array(path[places])).combine_chunks()
        mine, ends = alone[document], pa.array(np.append(0, np.cumsum(many[other])), pa.int32())
        pairs = [pa.ListArray.from_arrays(ends, pa.array(v[~mine], pa.int32())) for v in (term, hits)]
        packed = _packed(many[one], term[mine], len(chosen), 4)
        singles = [of(one), pa.array(many[one], pa.int32()), packed, *[pa.nulls(len(one), t) for t in _ARROW_MET.types[3:]]]
        others = [of(other), *[pa.nulls(len(other), t) for t in _ARROW_MET.types[1:3]], *pairs]
        return pa.Table.from_batches([pa.RecordBatch.from_arrays(c, schema=_ARROW_MET) for c in (singles, others)])

    return run


def _packer(size: int):
    """A function for mapInArrow: from (path, terms) to (path, n, held), with packed terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = pc.list_value_length(batch["terms"]).to_numpy()
            held = _packed(n, pc.list_flatten(batch["terms"]).to_numpy(), size, 4)
            yield pa.RecordBatch.from_arrays([batch["path"], pa.array(n, pa.int32()), held], ["path", "n", "held"])

    return run


def _tester(tree: tuple, n_sure: int, size: int):
    """A function for mapInArrow: from (path, text) to (path, n, found), with the packed terms that a text contains."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _slices(batch, 0):
                document, term = _terms_in(part["text"].cast(pa.large_string()), tree, size - n_sure)
                n = np.bincount(document, minlength=part.num_rows)
                columns = [part["path"], pa.array(n, pa.int32()), _packed(n, term + n_sure, size, 4)]
                yield pa.RecordBatch.from_arrays(columns, ["path", "n", "found"]).filter(pa.array(n > 0))

    return run


def _settler(numbers: dict[str, list[int]], n_queries: int, n_sure: int):
    """A function for mapInArrow: from (path, held, found), the packed terms that a document can have and those that its texts
    contain, to (path, asked, matched).  The first ``n_sure`` terms need no text."""
    count, size = _query_counts(numbers, n_queries), len(numbers)
    step = max(1, _BYTES_AT_ONCE // max(n_queries, size))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(at, step) for at in range(0, batch.num_rows, step)):
                held = _unpacked(part["held_n"].to_numpy(), part["held"].to_pylist(), size, 4)
                parent, found = pc.list_parent_indices(part["found"]).to_numpy(), pc.list_flatten(part["found"])
                row, term = np.nonzero(_unpacked(found.field("n").to_numpy(), found.field("found").to_pylist(), size, 4))
                contained = np.zeros_like(held)
                contained[:, :n_sure] = True
                contained[parent[row], term] = True
                yield count(part["path"], *np.nonzero(held & contained))

    return run


def _query_matches(folder: str, files: DataFrame, numbers: dict[str, list[int]], n_queries: int, tree: tuple, lists: int) -> DataFrame:
    """(path, asked, matched): the queries with terms in a document and how many.  ``numbers`` has the queries of each term, terms
    that are n-grams themselves come first; ``tree`` has the other ones."""
    spark, names = files.sparkSession, list(numbers)
    n_sure = sum(len(t) <= GRAM for t in names)
    rows = rarest_grams(spark, folder, spark.createDataFrame([(t,) for t in names], "term string"), lists).collect()
    slots = {key: i for i, key in enumerate(dict.fromkeys((r.bucket, r.gram) for r in rows))}
    chosen, place, filled = np.full((len(names), lists), -1), {t: i for i, t in enumerate(names)}, [0] * len(names)
    for r in rows:
        term = place[r.term]
        chosen[term, filled[term]] = slots[r.bucket, r.gram]
        filled[term] += 1
    wanted = spark.createDataFrame([(*key, i) for key, i in slots.items()], "bucket int, gram string, slot int")
    buckets = sorted({bucket for bucket, _ in slots})
    postings = _postings(spark, folder).filter(F.col("bucket").isin(buckets)).join(F.broadcast(wanted), ["bucket", "gram"])
    live = _live(spark, folder)
    # documents whose path no other has are settled in their block, the others are gathered
    again = live.groupBy("path").agg(F.count(F.lit(1)).alias("times")).filter("times > 1").select("path", F.lit(False).alias("single"))
    live = live.join(broadcast_if_small(again), "path", "left").withColumn("alone", F.col("path").isNotNull() & F.coalesce("single", F.lit(True)))
    met = durable(_cogrouped(postings.select("level", "block", "slot", "n", "docs"), live.drop("single"), _block_meeter(chosen), _MET), "candidates")
    each = spark.createDataFrame(list(enumerate(filled)), "term int, lists int")
    hits = met.filter("hits IS NOT NULL").select("path", F.inline(F.arrays_zip("terms", "hits"))).withColumnRenamed("terms", "term")
    whole = hits.groupBy("path", "term").agg(F.sum("hits").alias("n")).join(F.broadcast(each), "term").filter("n = lists")
    gathered = whole.groupBy("path").agg(F.collect_list("term").alias("terms")).mapInArrow(_packer(len(names)), "path string, n int, held binary")
    held = met.filter("hits IS NULL").select("path", "n", "held").unionByName(gathered)
    # contents stay where they are; without a table of paths that fits into a task all are read
    texts = _among(files.filter("path IS NOT NULL AND content IS NOT NULL"), held).select("path", X.lower("content").alias("text"))
    tested = texts.mapInArrow(_tester(tree, n_sure, len(names)), "path string, n int, found binary")
    both = held.select("path", F.struct("n", "held").alias("held"), F.lit(None).cast("struct<n:int,found:binary>").alias("found")).unionByName(
        tested.select("path", F.lit(None).cast("struct<n:int,held:binary>").alias("held"), F.struct("n", "found").alias("found"))
    )
    gathered = both.groupBy("path").agg(F.first("held", ignorenulls=True).alias("held"), F.collect_list("found").alias("found"))
    settled = gathered.filter("held IS NOT NULL").select("path", F.col("held.n").alias("held_n"), "held.held", "found")
    return settled.mapInArrow(_settler(numbers, n_queries, n_sure), _COUNTS)


def _among(files: DataFrame, paths: DataFrame, most: int = 200_000) -> DataFrame:
    """``files`` whose path is in ``paths``, or all of them if these paths are more than a task takes."""
    wanted = paths.select("path").distinct()
    return pick(files, paths) if wanted.limit(most + 1).count() <= most else files


def stored_substring_found(folder: str, files: DataFrame, queries: DataFrame, lists: int = 2) -> DataFrame:
    """(query_id, path, matched, rank): documents that contain terms of the queries as substrings.

    The terms of a batch are numbers, and a task counts a document's queries; more terms meet the postings by joins.
    """
    terms, widest = search_terms(queries)
    rows = _small_terms(terms)
    numbers, asked = _numbered(terms, sorted(rows, key=lambda r: len(r.term) > GRAM)) if rows else ({}, None)
    if rows and (tree := _byte_tree([t.encode() for t in numbers if len(t) > GRAM])) is not None:
        counts = _query_matches(folder, files, numbers, len({r.query_id for r in rows}), tree, lists)
        return _ranked_counts(counts, asked)
    return rank_by_terms(holding(files.sparkSession, folder, files, terms, lists), terms, widest)
