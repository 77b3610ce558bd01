"""Spelling variants: words in a trie of letter-group counts, searched with a budget of one surplus and one deficit.

Letters form groups; a word's vector has the count of its letters in each.  One inserted letter gives a vector
one surplus, one deleted letter one deficit, a replaced one at most one of each.  So the near words of a word lie
at the leaves that a depth-first search through the trie of vectors reaches while it spends at most one surplus and
one deficit; the words of these leaves are compared letter by letter.  The surplus is spent first: a pair whose first
difference is a deficit is found from its other end.

The trie is spread over tasks.  A node with more words than fit into a cell is inner; the others directly
below are cells.  There are few inner nodes, for each holds many words: every task knows them, goes through
them depth-first with its words, and sends each, with what it has spent, to the cells that it
reaches.  A cell builds the rest of the trie from its own words and goes on with its visitors.
A leaf with more words than a cell is dealt into parts, all of which a visitor goes to; a cell with very many
visitors is copied, and each copy takes a share of them.

Defined results: null and empty texts have no words; a row without ``doc_id`` counts as one with an empty id.
Repeated rows count each.  Very long texts and words are read whole, in steps.  Ties of the largest count go to the
first word in code-point order.  An empty table has no words.  Columns other than the two named ones are not looked at.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import durable, forget
from .common import query, rows_of, table, text_steps

#: Letters whose codes agree in their lowest five bits form a group.  The trie asks for the groups in this order, usual letters
#: first; those that are not named come last.
ORDER = "etaoinsrhldcumfpgwybvkxjqz"
GROUPS = 32
#: A run whose hash this number divides loses a letter.
CUT = 97
SHORTEST = 5
LEAST = 3
#: A word's form is at least so many times as frequent.
TIMES = 2
#: Words of a cell, and visitors that one copy of it takes.
CELL = 1000
VISITORS = 20_000
#: Inner nodes at most; cells grow when a vocabulary would have more.
INNER = 50_000
#: Depths of the trie's top that are counted in one pass.
DEPTHS = 8
#: Words of a leaf, and visitors that are tested against a leaf at once.
LEAF = 32
VISITS = 2000
#: Halves of two words to compare: 0 and 1 are first, 2 and 3 last halves, 1 and 3 those of a word that is shorter by one.
HALVES = ((0, 0), (0, 1), (1, 0), (2, 2), (2, 3), (3, 2))
#: Distinct words that a task counts before it hands them on, and code points of a text that it reads at once.
HELD = 200_000
STEP = 1 << 20

_PLACE = np.argsort([*(ord(c) % GROUPS for c in ORDER), *sorted(set(range(GROUPS)) - {ord(c) % GROUPS for c in ORDER})])
_RUN = re.compile("[A-Za-zÀ-ÿ]+")
_OTHER = re.compile("[^A-Za-zÀ-ÿ]")

WORDS = pa.schema([("word", pa.string()), ("n", pa.int64())])
NODES = pa.schema([("node", pa.binary()), ("n", pa.int64())])
SENT = pa.schema([("cell", pa.binary()), ("part", pa.int32()), ("spent", pa.int32()), ("word", pa.string()), ("n", pa.int64())])
SENT_TYPE = "cell binary, part int, spent int, word string, n long"
FOUND = pa.schema([("word", pa.string()), ("n_near", pa.int64()), ("best_n", pa.int64()), ("best", pa.string())])


def runs(text: str) -> Iterator[list[str]]:
    """The runs of letters of a text, about STEP code points at a time."""
    at = 0
    while at < len(text):
        stop = _OTHER.search(text, at + STEP)
        end = stop.start() if stop else len(text)
        yield _RUN.findall(text, at, end)
        at = end


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: Counter[str] = Counter()
    for rows, texts in text_steps(batches):
        for doc_id, text in zip(rows.column(0).to_pylist(), texts, strict=True):
            start = crc32(f"{'' if doc_id is None else doc_id}:".encode())
            # lower() of bytes changes A-Z only
            for found in runs(text.lower().decode()):
                for run, n in Counter(found).items():
                    h = crc32(run.encode(), start)
                    if h % CUT == 0:
                        at = h % len(run)
                        run = run[:at] + run[at + 1 :]
                    if len(run) >= SHORTEST:
                        held[run] += n
                if len(held) >= HELD:
                    yield rows_of(WORDS, list(held), list(held.values()))
                    held.clear()
    yield rows_of(WORDS, list(held), list(held.values()))


def vocabulary(documents: DataFrame) -> DataFrame:
    """(word, n): the words of at least SHORTEST code points that occur LEAST times or more."""
    slim = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    words = slim.mapInArrow(_words, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return words.filter(F.col("n") >= LEAST)


def vectors(words: list[str]) -> np.ndarray:
    """Letters of each group in every word, one row per word; a count above 255 is 255, which brings no two words further apart."""
    letters = np.frombuffer("".join(words).encode("utf-32-le"), dtype="<u4")
    row = np.repeat(np.arange(len(words)), [len(w) for w in words])
    counts = np.bincount(row * GROUPS + _PLACE[letters % GROUPS], minlength=len(words) * GROUPS)
    return np.minimum(counts, 255).astype(np.uint8).reshape(-1, GROUPS)


def one_edit(a: str, b: str) -> bool:
    """Whether two words differ by exactly one inserted, deleted or replaced letter."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    at = 0
    for at, (x, y) in enumerate(zip(a, b)):
        if x != y:
            break
    else:
        return len(a) < len(b)
    return a[at + (len(a) == len(b)) :] == b[at + 1 :]


def step(seekers: tuple, counts: np.ndarray, child: int) -> tuple:
    """The seekers that go on to a child: nothing spent, the surplus spent, both spent.

    The surplus has to be spent first, so of two words only one finds the other.
    """
    free, some, spent = seekers
    f, s, e = counts[free], counts[some], counts[spent]
    return (
        free[f == child],
        np.concatenate([free[f == child - 1], some[s == child]]) if child else some[s == child],
        np.concatenate([some[s == child + 1], spent[e == child]]),
    )


def nodes_below(words: DataFrame, full: dict[bytes, int], start: int) -> DataFrame:
    """(node, n): the nodes of the DEPTHS depths after ``start`` below the nodes ``full``, and their words."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[bytes] = Counter()
        for batch in batches:
            for row in vectors(batch.column(0).to_pylist()):
                whole = row.tobytes()
                if whole[:start] in full:
                    held.update(whole[:depth] for depth in range(start + 1, min(start + DEPTHS, GROUPS) + 1))
            if len(held) >= HELD:
                yield rows_of(NODES, list(held), list(held.values()))
                held.clear()
        yield rows_of(NODES, list(held), list(held.values()))

    return words.select("word").mapInArrow(count, "node binary, n long").groupBy("node").agg(F.sum("n").alias("n"))


def top_of_trie(words: DataFrame, cell: int, inner: int) -> tuple[int, dict[bytes, int], dict[bytes, list[int]]]:
    """The words that a cell holds; the words of nodes with more; and the children of these.  A node is the row of its counts.

    At most ``inner`` nodes, with 256 children each, whatever the vocabulary.
    """
    total = words.count()
    # fewer than total / size nodes of one depth can hold more than size words
    size = max(cell, -(-total * (GROUPS + 1) // inner))

    full: dict[bytes, int] = {b"": total}
    children: dict[bytes, list[int]] = {}
    for start in range(0, GROUPS, DEPTHS):
        if not any(len(node) == start for node in full):
            break
        nodes = durable(nodes_below(words, full, start), "nodes")
        full |= {bytes(r.node): r.n for r in nodes.filter(F.col("n") > size).collect()}
        parents = words.sparkSession.createDataFrame([(bytearray(k),) for k in full], "parent binary")
        above = F.expr("substring(node, 1, octet_length(node) - 1)")
        for r in nodes.withColumn("parent", above).join(parents, "parent").select("node").collect():
            children.setdefault(bytes(r.node[:-1]), []).append(r.node[-1])
        forget(nodes)
    return size, full, children


def reached(counts: np.ndarray, full: dict, children: dict) -> Iterator[tuple[bytes, tuple]]:
    """Every cell that words reach, depth-first from the root, with the words' places by what they have spent."""
    none = np.empty(0, dtype=np.int64)
    stack = [(b"", (np.arange(len(counts)), none, none))]
    while stack:
        node, seekers = stack.pop()
        if node not in full or len(node) == GROUPS:
            yield node, seekers
            continue
        column = counts[:, len(node)]
        for child in children.get(node, ()):
            further = step(seekers, column, child)
            if any(map(len, further)):
                stack.append((node + bytes([child]), further))


def send(words: DataFrame, size: int, full: dict, children: dict, visitors: int) -> DataFrame:
    """(cell, part, spent, word, n): every word in its cell (spent is -1), and as visitor in all cells that its budget reaches."""
    top = words.sparkSession.sparkContext.broadcast((full, children))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[bytes] = Counter()
        for batch in batches:
            for cell, seekers in reached(vectors(batch.column(0).to_pylist()), *top.value):
                held[cell] += sum(map(len, seekers))
        yield rows_of(NODES, list(held), list(held.values()))

    counts = words.select("word").mapInArrow(count, "node binary, n long").groupBy("node").agg(F.sum("n").alias("n"))
    # copies of cells with very many visitors: fewer than all visits / visitors
    copies = {bytes(r.node): -(-r.n // visitors) for r in counts.filter(F.col("n") > visitors).collect()}
    copied = words.sparkSession.sparkContext.broadcast(copies)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        full, children = top.value
        for batch in batches:
            names = batch.column(0).to_pylist()
            counts = vectors(names)
            dealt = np.array([crc32(w.encode()) for w in names], dtype=np.int64)
            cells, rows, parts, spent = [], [], [], []

            def put(cell: bytes, who: np.ndarray, part: np.ndarray, state: int) -> None:
                cells.append((cell, len(who)))
                rows.append(who)
                parts.append(part)
                spent.append(np.full(len(who), state))

            for cell, seekers in reached(counts, full, children):
                blocks, n = -(-full.get(cell, 1) // size), copied.value.get(cell, 1)
                for state, who in enumerate(seekers):
                    for block in range(blocks):
                        put(cell, who, block * n + dealt[who] // blocks % n, state)
                own = seekers[0][(counts[seekers[0], : len(cell)] == np.frombuffer(cell, dtype=np.uint8)).all(axis=1)]
                for copy in range(n):
                    put(cell, own, dealt[own] % blocks * n + copy, -1)
            at = np.concatenate(rows)
            for i in range(0, len(at), 100_000):
                take = pa.array(at[i : i + 100_000])
                # cells are few, so their names are repeated by place
                names_of = pa.array([c for c, _ in cells], type=pa.binary())
                which = np.repeat(np.arange(len(cells)), [k for _, k in cells])[i : i + 100_000]
                yield rows_of(
                    SENT, names_of.take(pa.array(which)), np.concatenate(parts)[i : i + 100_000].astype(np.int32),
                    np.concatenate(spent)[i : i + 100_000].astype(np.int32), batch.column(0).take(take), batch.column(1).take(take),
                )

    return words.select("word", "n").mapInArrow(run, SENT_TYPE)


def search(rows: pa.Table) -> pa.Table:
    """Near words of a cell's words and visitors: the rest of the trie, depth-first with all visitors that reach a node.

    A node with at most LEAF words is a leaf.  Its words are verified: one edit leaves the first or the last half of the shorter
    word in its place; then come the rest of the vectors and the letters.
    """
    depth = len(rows.column("cell")[0].as_py())
    names, n = rows.column("word").to_pylist(), rows.column("n").to_pylist()
    spent = rows.column("spent").to_numpy()
    counts = vectors(names).astype(np.int16)
    ends = [(w[: len(w) // 2], w[: (len(w) - 1) // 2], w[-(len(w) // 2) :], w[len(w) - (len(w) - 1) // 2 :]) for w in names]
    halves = np.array([[*map(hash, e)] for e in ends], dtype=np.int64).T
    found: dict[str, tuple] = {}

    def near(word: str, other: str, m: int) -> None:
        k, best_n, best = found.get(word, (0, 0, ""))
        found[word] = (k + 1, m, other) if m > best_n or m == best_n and other < best else (k + 1, best_n, best)

    stack = [(np.flatnonzero(spent < 0), depth, tuple(np.flatnonzero(spent == i) for i in range(3)))]
    while stack:
        words, depth, seekers = stack.pop()
        if len(words) > LEAF and depth < GROUPS:
            column = counts[:, depth]
            values = column[words]
            for child in np.unique(values):
                further = step(seekers, column, child)
                if any(map(len, further)):
                    stack.append((words[values == child], depth + 1, further))
            continue
        for state, who in enumerate(seekers):
            for at in range(0, len(who) if len(words) else 0, VISITS):
                few = who[at : at + VISITS]
                alike = np.zeros((len(few), len(words)), dtype=bool)
                for x, y in HALVES:
                    alike |= halves[x][few][:, None] == halves[y][words][None, :]
                i, j = np.nonzero(alike)
                i, j = few[i], words[j]
                more = counts[j, depth:] - counts[i, depth:]
                fits = (np.maximum(more, 0).sum(axis=1) <= (state == 0)) & (np.maximum(-more, 0).sum(axis=1) <= (state < 2))
                if state == 0 and depth < GROUPS:
                    # the first of the groups that differ has the surplus
                    fits &= more[np.arange(len(more)), (more != 0).argmax(axis=1)] >= 0
                same = ~more[fits].any(axis=1)
                for a, b, equal in zip(i[fits].tolist(), j[fits].tolist(), same.tolist()):
                    word, other = names[a], names[b]
                    # words of equal vectors find each other
                    if one_edit(word, other) and not (state == 0 and equal and other < word):
                        near(word, other, n[b])
                        near(other, word, n[a])
    return pa.table([list(found), *([x[i] for x in found.values()] for i in range(3))], schema=FOUND)


def near_words(words: DataFrame, cell: int = CELL, visitors: int = VISITORS, inner: int = INNER) -> DataFrame:
    """(word, n_near, best, best_n) of every word of ``words`` (word, n) with a near word; best is the most frequent of them."""
    sent = send(words, *top_of_trie(words, cell, inner), visitors)
    found = sent.groupBy("cell", "part").applyInArrow(search, "word string, n_near long, best_n long, best string")
    best = F.min(F.struct((-F.col("best_n")).alias("n"), F.col("best").alias("word"))).alias("b")
    found = found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best)
    return found.select("word", "n_near", F.col("b.word").alias("best"), (-F.col("b.n")).alias("best_n"))


def last_forms(forms: DataFrame) -> DataFrame:
    """(word, root) of ``forms`` (word, form): the end of the chain of forms; the ways double in every round."""
    ways = durable(forms.select("word", F.col("form").alias("root")), "ways")
    while True:
        further = ways.select(F.col("word").alias("root"), F.col("root").alias("further"))
        longer = ways.join(further, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved"))
        longer = durable(longer, "ways")
        forget(ways)
        ways = longer
        if not ways.filter("moved").take(1):
            return ways.select("word", "root")
        ways = ways.select("word", "root")


def spelling_variants(documents: DataFrame, cell: int = CELL, visitors: int = VISITORS, inner: int = INNER) -> DataFrame:
    """One row per word: word, n, n_near, form, form_n, root."""
    words = durable(vocabulary(documents), "words")
    near = near_words(words, cell, visitors, inner)
    likely = F.col("best_n") >= TIMES * F.col("n")
    rows = words.join(near, "word", "left").select(
        "word",
        "n",
        F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(likely, F.col("best")).alias("form"),
        F.when(likely, F.col("best_n")).alias("form_n"),
    )
    rows = durable(rows, "forms")
    roots = last_forms(rows.filter("form is not null"))
    return rows.join(roots, "word", "left").withColumn("root", F.coalesce("root", "word"))


OP13_SQL = r"""
WITH RECURSIVE crc AS (
  SELECT list(v ORDER BY i) AS t FROM (
    SELECT i, list_reduce(range(8), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i) AS v FROM range(256) r(i))),
runs AS (
  SELECT doc_id, run, count(*) AS k FROM (
    SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                             '[A-Za-z\x{00C0}-\x{00FF}]+')) AS run FROM documents)
  GROUP BY ALL),
bytes AS (
  SELECT run, k, hex(coalesce(doc_id::VARCHAR, '') || ':' || run) AS digits FROM runs),
hashed AS (
  SELECT run, k, xor(list_reduce(list_transform(range(length(digits) // 2), lambda i: (instr('0123456789ABCDEF', digits[2 * i + 1]) - 1) * 16
                                                                                    + instr('0123456789ABCDEF', digits[2 * i + 2]) - 1),
                                 lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295), 4294967295) AS h
  FROM bytes, crc),
words AS (
  SELECT word, sum(k)::BIGINT AS n FROM (
    SELECT CASE WHEN h % 97 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, k FROM hashed)
  WHERE length(word) >= 5 GROUP BY word HAVING sum(k) >= 3),
shorter AS (SELECT word, n, i, substr(word, 1, i) || substr(word, i + 2) AS rest FROM words, range(200) r(i) WHERE i < length(word)),
pairs AS (
  SELECT a.word, b.word AS other, b.n FROM words a JOIN shorter b ON a.word = b.rest
  UNION SELECT b.word, a.word, a.n FROM words a JOIN shorter b ON a.word = b.rest
  UNION SELECT a.word, b.word, b.n FROM shorter a JOIN shorter b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word),
near AS (
  SELECT word, count(*) AS n_near, max(n) AS best_n FROM pairs GROUP BY word),
forms AS (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near,
         CASE WHEN best_n >= 2 * w.n THEN (SELECT min(other) FROM pairs p WHERE p.word = w.word AND p.n = r.best_n) END AS form,
         CASE WHEN best_n >= 2 * w.n THEN best_n END AS form_n
  FROM words w LEFT JOIN near r ON r.word = w.word),
chain AS (
  SELECT word, word AS root, form AS following FROM forms
  UNION ALL
  SELECT c.word, f.word, f.form FROM chain c JOIN forms f ON f.word = c.following)
SELECT f.word, f.n, f.n_near, f.form, f.form_n, c.root FROM forms f JOIN chain c ON c.word = f.word AND c.following IS NULL
"""


@query("op13_spelling_variants", OP13_SQL)
def op13_spelling_variants(spark, folder):
    return spelling_variants(table(spark, folder, "documents"))
