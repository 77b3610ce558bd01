"""Near-duplicates against all pairs of a small table."""

import random
import re

from leafmill.llm import near_duplicates as N


def sets_of(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in text or ""))
    if len(words) < 5:
        return {tuple(words)} - {()}
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def plain(rows, share=85):
    """doc_id -> smallest reachable doc_id by all pairs."""
    sets = {i: sets_of(t) for i, t in rows if i is not None}
    root = {i: i for i in sets}
    changed = True
    while changed:
        changed = False
        for a in sets:
            for b in sets:
                if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= share * len(sets[a] | sets[b]) and root[a] != root[b]:
                    root[a] = root[b] = min(root[a], root[b])
                    changed = True
    return sets, root


def corpus(seed=5):
    draw = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    texts = []
    for size in (3, 4, 5, 6, 12, 40, 120, 300):
        base = [draw.choice(vocabulary) for _ in range(size)]
        for _ in range(12):
            words = list(base)
            for _ in range(draw.randrange(0, 1 + size // 40)):
                words[draw.randrange(size)] = draw.choice(vocabulary)
            if draw.random() < 0.3:
                words = words[: draw.randrange(1, size + 1)]
            texts.append(" ".join(words))
    texts += ["", "  \t\n", None, "ONE two", "one  TWO", "É é", "é É", "x" * 30000, "y " * 30000]
    draw.shuffle(texts)
    return list(enumerate(texts))


def test_components_equal_all_pairs(spark):
    rows = corpus()
    given = [(i, t, 1, "c") for i, t in rows] + [(rows[0][0], rows[0][1], 1, "c"), (None, "one two", 1, "c")]
    df = spark.createDataFrame(given, "doc_id long, text string, rep int, key string").repartition(3)
    sets, root = plain(rows)
    got = N.near_duplicates(df).collect()
    assert len(got) == len(given)
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
            continue
        assert (r.n_shingles, r.component_id, r.kept) == (len(sets[r.doc_id]), root[r.doc_id], root[r.doc_id] == r.doc_id)
    kept = N.one_of_each(df)
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.filter("doc_id is not null").collect()) == sorted(i for i in root if root[i] == i)


def test_empty_table_and_no_links(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert N.near_duplicates(df).collect() == []
    df = spark.createDataFrame([(1, "a b c d e f"), (2, "g h i j k l")], "doc_id long, text string")
    assert sorted((r.doc_id, r.component_id) for r in N.near_duplicates(df).collect()) == [(1, 1), (2, 2)]


def star(copies=1000, length=200, apart=3):
    """Copies of one text, each with words of its own: all reach the share with the text, no two with each other."""
    base = [f"b{i}" for i in range(length)]
    rows = []
    for c in range(copies):
        words = list(base)
        start = random.Random(c).randrange(length - 20)
        for k in range(apart):
            words[start + 6 * k] = f"c{c}x{k}"
        rows.append((2 * c, " ".join(words)))
    return [*rows, (copies + 1, " ".join(base))]


def test_star_around_a_middle_id_is_one_component(spark):
    rows = star()
    centre = rows[-1][0]
    sets = {i: sets_of(t) for i, t in rows}
    alike = lambda a, b: 100 * len(sets[a] & sets[b]) >= share * len(sets[a] | sets[b])
    assert all(alike(i, centre) for i in sets)
    assert sum(alike(0, i) for i in sets) < len(sets) / 2
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    # one round draws the smallest id only, so the finish has to find what is left
    assert {r.component_id for r in N.near_duplicates(df, least_rounds=1).collect()} == {0}
    assert {r.component_id for r in N.near_duplicates(df).collect()} == {0}


def test_finish_without_rounds_equals_all_pairs(spark):
    rows = corpus(11)
    sets, root = plain(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = N.near_duplicates(df, least_rounds=1, small=0)
    assert {r.doc_id: r.component_id for r in got.collect()} == root
