"""The Merkle manifest against a plain restatement, with small blocks."""

import random
import zlib
from hashlib import sha256

import pytest
from leafmill.llm import manifest as M


def h(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def plain_leaf(row):
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def tree_of(nodes):
    """All levels, the root's last."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([h(*levels[-1][i : i + 3]) for i in range(0, len(levels[-1]), 3)])
    return levels


def up(levels, at, node):
    """(siblings, recomputed root) of a node that replaces the one at a place."""
    found = []
    for level in levels[:-1]:
        run = list(level[at - at % 3 : at - at % 3 + 3])
        run[at % 3] = node
        found += run[: at % 3] + run[at % 3 + 1 :]
        node, at = h(*run), at // 3
    return found, node


def plain(rows):
    sources = sorted({r[1] for r in rows}, key=lambda s: (s is not None, (s or "").encode()))
    order = lambda r: (r[0] is not None, r[0] or 0, plain_leaf(r))
    per = {s: sorted((r for r in rows if r[1] == s), key=order) for s in sources}
    trees = {s: tree_of([plain_leaf(r) for r in per[s]]) for s in sources}
    top = tree_of([trees[s][-1][0] for s in sources])
    out = []
    for k, s in enumerate(sources):
        for i, r in enumerate(per[s]):
            new = r
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0 and r[4] is not None:
                new = (*r[:4], r[4].replace("\n", ""))
            own, node = up(trees[s], i, plain_leaf(new))
            above, root = up(top, k, node)
            out.append((r[0], plain_leaf(r), trees[s][-1][0], top[-1][0], h(*own, *above), root, root == top[-1][0]))
    return sorted(out, key=str)


def rows_of(n, sources, seed):
    draw = random.Random(seed)
    out = []
    for i in range(n):
        text = draw.choice([None, "", "one\ntwo", "é\n" * draw.randrange(4), "plain", "x" * 3000 + "\n"])
        out.append((i * 7 % 1000, draw.choice(sources), draw.choice(["en", None]), draw.choice([None, i]), text))
    return out


@pytest.mark.parametrize(
    ("levels", "n", "sources"),
    [(1, 95, ["a", "b", None, "é", "z", "", "c", "d", "e", "f", "g"]), (2, 200, ["hot"] * 30 + list("abcdefghijklmnop")), (6, 60, ["one"]), (6, 1, [None])],
)
def test_equals_plain_tree(spark, tmp_path, monkeypatch, levels, n, sources):
    whole = M.proofs
    monkeypatch.setattr(M, "proofs", lambda documents: whole(documents, levels=levels))
    rows = rows_of(n, sources, n)
    rows += [(None, sources[0], "en", 1, "no\nid"), rows[0], (rows[0][0], *rows[0][1:4], "twice\n")][: 3 * (n > 1)]
    df = spark.createDataFrame(
        [(*r, "t", 9) for r in rows], "doc_id long, source string, lang string, n_chars long, text string, tree string, idx long"
    )
    df.repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((tuple(r) for r in M.op12_merkle_manifest(spark, str(tmp_path)).collect()), key=str)
    assert got == plain(rows)


def test_versions_share_all_but_the_copied_path(spark):
    rows = rows_of(120, ["a", "b"], 4)
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    got = M.proofs(df, levels=2).collect()
    assert any(r.version is None for r in got) and any(r.version for r in got)
    for r in got:
        if r.version is not None:
            assert len(r.version) == len(r.proof) and r.version[-1] == r.folded_root


def test_empty_table(spark):
    assert M.proofs(spark.createDataFrame([], "doc_id long, source string, lang string, n_chars long, text string")).collect() == []
