"""SimHash near-duplicates against a plain restatement over all pairs."""

import random
import re

import xxhash
from leafmill.llm import simhash as S


def plain_print(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_roots(prints, limit=4):
    """print -> smallest print reachable."""
    root = {p: p for p in prints}

    def top(p):
        while root[p] != p:
            p = root[p]
        return p

    for a in prints:
        for b in prints:
            if a < b and bin(a ^ b).count("1") <= limit:
                x, y = top(a), top(b)
                root[max(x, y)] = min(x, y)
    return {p: top(p) for p in prints}


def unsigned(value):
    return value % (1 << 64)


def test_fingerprints_over_steps(monkeypatch):
    draw = random.Random(3)
    texts = ["", " \t\n", "One", "a b c", "A b C d", "x" * 5000]
    texts += [" ".join(draw.choice(["é", "Word", "ÀB", "tail\x0b"]) for _ in range(n)) for n in (4, 5, 60, 700)]
    for step in (1, 7, 1 << 20):
        monkeypatch.setattr(S, "STEP", step)
        assert [unsigned(S.fingerprint(t.encode())) for t in texts] == [plain_print(t) for t in texts]


def clusters(seed=11):
    """Fingerprints in clouds: chains, a star, a dense cloud and strangers."""
    draw = random.Random(seed)
    flip = lambda p, n: p ^ sum(1 << b for b in draw.sample(range(64), n))
    out = {0, 1, (1 << 64) - 1, 0b11111}
    for _ in range(40):
        out.add(draw.getrandbits(64))
    for n in (1, 2, 3, 4, 5):
        p = draw.getrandbits(64)
        for _ in range(12):
            out.add(p)
            p = flip(p, n)
    centre = draw.getrandbits(64)
    out |= {flip(centre, draw.randrange(2, 9)) for _ in range(250)}
    few = draw.sample(range(64), 9)  # a dense cloud on nine unstable bits
    out |= {centre ^ sum(1 << b for b in few if draw.random() < 0.5) for _ in range(150)}
    return sorted(out)


def test_components_equal_all_pairs(spark):
    prints = clusters()
    roots = plain_roots(prints)
    groups = {}
    for p, r in roots.items():
        groups.setdefault(r, set()).add(p)
    df = spark.createDataFrame([(S.signed(p),) for p in prints], "print long")
    for rounds, block in ((3, 1000), (0, 7)):
        got = {p: p for p in prints}
        for row in S.print_components(df, rounds=rounds, block=block).collect():
            got[unsigned(row.node)] = unsigned(row.root)
        found = {}
        for p, r in got.items():
            found.setdefault(r, set()).add(p)
        assert sorted(map(sorted, found.values())) == sorted(map(sorted, groups.values()))


def test_any_pair_within_the_limit_shares_a_cell(spark):
    draw = random.Random(7)
    pairs = []
    for _ in range(400):
        a = draw.getrandbits(64)
        pairs.append((S.signed(a), S.signed(a ^ sum(1 << b for b in draw.sample(range(64), 4)))))
    df = spark.createDataFrame(pairs, "a long, b long")
    left = S.cells(df.selectExpr("a as print")).withColumnRenamed("print", "a")
    right = S.cells(df.selectExpr("b as print")).withColumnRenamed("print", "b")
    assert df.join(left, "a").join(right, ["b", "cell"]).select("a", "b").distinct().count() == len(set(pairs))


def test_documents(spark):
    draw = random.Random(5)
    words = [f"w{i}" for i in range(500)]
    rows = []
    for base in range(6):
        text = [draw.choice(words) for _ in range(150 + 80 * base)]
        for _ in range(8):
            copy = list(text)
            for _ in range(draw.randrange(0, 4)):
                copy[draw.randrange(len(copy))] = draw.choice(words)
            rows.append(" ".join(copy))
    rows += [None, "", " \n ", "alone", "ALONE", "two words", "x" * 4000, "é " * 5000]
    draw.shuffle(rows)
    given = [(i + 10, t, "a", i) for i, t in enumerate(rows)] + [(10, rows[0], "b", 0), (None, rows[1], "c", 1)]
    df = spark.createDataFrame(given, "doc_id long, text string, print string, cell long").repartition(5)
    prints = {i: plain_print(t) for i, t, *_ in given if i is not None}
    roots = plain_roots(set(prints.values()))
    least = {}
    for i, p in prints.items():
        least[roots[p]] = min(i, least.get(roots[p], i))
    got = S.simhash_duplicates(df).collect()
    assert len(got) == len(given)
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None and r.fingerprint == f"{plain_print(rows[1]):016x}"
        else:
            assert (r.fingerprint, r.component_id) == (f"{prints[r.doc_id]:016x}", least[roots[prints[r.doc_id]]])


def test_empty_table(spark):
    assert S.simhash_duplicates(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_members_of_cells_are_joined_in_blocks_only(spark):
    """A cell's sizes and open components come from windows; only the blocks of the exact finish are joined."""
    draw = random.Random(11)
    rows = [(cell, cell * 100 + n, cell * 100 + draw.choice([0, 0, n])) for cell in range(4) for n in range(12)]
    members = spark.createDataFrame(rows, "cell long, print long, comp long")
    want = {c for c in range(4) if len({comp for cell, _, comp in rows if cell == c}) > 1}
    assert {r.cell for r in S.several(members).collect()} == want
    pairs = S.rest(members, 4, 5)
    near = {
        (min(a, b), max(a, b)) for c, a, x in rows for d, b, y in rows
        if c == d and x != y and bin(a ^ b).count("1") <= 4 and bin(S_point(a) ^ S_point(b)).count("1") <= 4
    }
    assert {(min(r.a, r.b), max(r.a, r.b)) for r in pairs.collect()} == near
    assert pairs._jdf.queryExecution().optimizedPlan().toString().count("Join Inner") == 1


def S_point(value):
    some, both = (value | value >> 1) & S._LOW, value & value >> 1 & S._LOW
    return some | both << 1
