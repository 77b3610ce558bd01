"""Spelling variants against all pairs of a small vocabulary."""

import random
import re
import zlib
from collections import Counter

from leafmill.llm import variants as V


def distance_one(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain(counts):
    """word -> (n, n_near, form, form_n, root)."""
    near = {w: [o for o in counts if distance_one(w, o)] for w in counts}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda o: (-counts[o], o), default=None)
        form[w] = best if best is not None and counts[best] >= 2 * counts[w] else None
    out = {}
    for w in counts:
        root = w
        while form[root] is not None:
            root = form[root]
        out[w] = (counts[w], len(near[w]), form[w], counts.get(form[w]), root)
    return out


def words_of(rows):
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 5:
                counts[run] += 1
    return {w: n for w, n in counts.items() if n >= 3}


def vocabulary(seed=2):
    draw = random.Random(seed)
    out = {}
    for _ in range(60):
        word = "".join(draw.choice("abcnoé") for _ in range(draw.randrange(5, 9)))
        for _ in range(8):
            out[word] = draw.choice([3, 3, 4, 6, 12, 25, 50])
            letters = list(word)
            at = draw.randrange(len(letters))
            kind = draw.randrange(3)
            letters[at : at + (kind != 0)] = [] if kind == 1 and len(word) > 5 else [draw.choice("abcnoéz")]
            word = "".join(letters)
    out |= {"x" * 3000: 9, "x" * 3001: 3, "abcde": 7, "edcba": 7, "ecdba": 3}
    return out


def test_near_words_equal_all_pairs(spark):
    counts = vocabulary()
    expected = plain(counts)
    words = spark.createDataFrame(list(counts.items()), "word string, n long").repartition(3)
    for cell, visitors, inner in ((500, 20_000, 200_000), (4, 5, 200_000), (1, 3, 200_000), (1, 100, 60)):
        got = {r.word: (r.n_near, r.best, r.best_n) for r in V.near_words(words, cell, visitors, inner).collect()}
        assert {w: x[0] for w, x in got.items()} == {w: e[1] for w, e in expected.items() if e[1]}
        for w, (_, best, n) in got.items():
            near = [o for o in counts if distance_one(w, o)]
            assert best == min(near, key=lambda o: (-counts[o], o)) and n == counts[best]


def test_chains_of_forms(spark):
    chain = [(f"w{i:03}", f"w{i + 1:03}") for i in range(40)]
    got = V.last_forms(spark.createDataFrame([*chain, ("other", "w005"), ("lone", "end")], "word string, form string"))
    assert {r.word: r.root for r in got.collect()} == {w: "w040" for w, _ in chain} | {"other": "w040", "lone": "end"}


def test_documents(spark, monkeypatch):
    draw = random.Random(9)
    some = list(vocabulary(4))
    texts = [" ".join(draw.choice(some) for _ in range(300)).replace("a", "A") for _ in range(30)]
    rows = [*enumerate(texts), (3, texts[3]), (None, texts[0]), (90, None), (91, ""), (92, "12 × cafésÉ " * 4)]
    rows.append((93, "colour colours-colour/colour " * 90_000))
    df = spark.createDataFrame([(*r, 1, "w") for r in rows], "doc_id long, text string, n long, word string").repartition(4)
    expected = plain(words_of(rows))
    got = {r.word: (r.n, r.n_near, r.form, r.form_n, r.root) for r in V.spelling_variants(df).collect()}
    assert got == expected and any(e[4] != w for w, e in expected.items())


def test_steps_and_flushes(monkeypatch):
    text = "Alpha beta,gamma delta" * 20
    whole = [run for step in V.runs(text) for run in step]
    monkeypatch.setattr(V, "STEP", 3)
    assert [run for step in V.runs(text) for run in step] == whole


def test_empty_table(spark):
    assert V.spelling_variants(spark.createDataFrame([], "doc_id long, text string")).collect() == []
