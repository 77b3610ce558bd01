"""The stored n-gram index against a plain scan, over several states of a corpus."""

import random

from conftest import values

from leafmill.operators import gram_index as GI
from leafmill.session import scratch_path


def model(contents, queries):
    out = set()
    for key, scope, terms in queries:
        for path, content in contents.items():
            if scope == "/" or path.startswith(scope + "/"):
                hits = sum(t in content.lower() for t in terms)
                if hits:
                    out.add((key, path, hits, round(hits / len(terms), 6)))
    return out


def test_states_of_an_index(spark, make_files):
    draw = random.Random(4)
    text = lambda: " ".join("".join(draw.choice("abcé") for _ in range(draw.randrange(1, 9))) for _ in range(12))
    folder, contents = scratch_path(spark, "gram-test"), {f"/d{i % 3}/f{i}": text() for i in range(30)}
    contents |= {"/empty": "", "/d0/long": "ab" * 20_000 + " ÉCB 漢字", "/d1/points": "... !!!"}
    queries = [(f"q{i}", ["/", "/d1"][i % 2], sorted({"".join(draw.choice("abcé") for _ in range(draw.randrange(1, 7))) for _ in range(3)})) for i in range(12)]
    queries += [("long", "/", ["ab" * 50]), ("han", "/", ["漢字"]), ("none", "/", ["zzz"])]
    table = spark.createDataFrame([(k, " ".join(t), s) for k, s, t in queries], "query_id string, query string, scope string")

    def check(where):
        rows = values(GI.stored_substring_found(where, make_files(contents), table), "query_id", "path", "matched", "rank")
        assert {(*r[:3], round(r[3], 6)) for r in rows} == model(contents, queries) and len(rows) == len(set(r[:2] for r in rows))

    GI.write_gram_index(make_files(contents), folder)
    check(folder)
    for _ in range(2):
        touched = draw.sample(sorted(contents), 8) + ["/never/there"]
        for path in touched[:4]:
            del contents[path]
        contents |= {path: text() for path in [*touched[4:8], f"/d1/new{len(contents)}"]}
        named = [(p,) for p in [*touched, touched[0], f"/d1/new{len(contents) - 1}"]]
        GI.update_gram_index(make_files(contents), spark.createDataFrame(named, "path string"), folder)
    check(folder)
    # a batch that broke off before its paths were written does not count
    broken = make_files({"/d1/half": "abc abc"})
    GI.document_grams(broken).write.partitionBy("bucket").parquet(f"{folder}/postings/level=3")
    assert GI.levels(spark, folder) == [0, 1, 2]
    check(folder)
    assert GI.update_gram_index(make_files(contents), spark.createDataFrame([], "path string"), folder) == 3
    merged = scratch_path(spark, "gram-test")
    GI.compact(spark, folder, merged)
    assert GI.levels(spark, merged) == [0]
    check(merged)


def test_empty_corpus(spark, make_files):
    folder, files = scratch_path(spark, "gram-test"), make_files({"/a": "x"}).limit(0)
    GI.write_gram_index(files, folder)
    table = spark.createDataFrame([("q", "abcd x"), ("none", "!")], "query_id string, query string")
    assert GI.stored_substring_found(folder, files, table).count() == 0


def test_ranks_gather_terms_by_document_alone(spark):
    from leafmill.operators import search as S

    pairs = spark.createDataFrame([("/a/x", "one"), ("/a/x", "two"), ("/b/y", "two"), ("/b/y", "other")], "path string, term string")
    queries = spark.createDataFrame([("q", "one two", "/"), ("r", "two three", "/b"), ("s", "none", "/")], "query_id string, query string, scope string")
    terms, widest = S.search_terms(queries)
    ranked = S.rank_by_terms(pairs, terms, widest)
    assert sorted(values(ranked, "query_id", "path", "matched", "rank")) == [("q", "/a/x", 2, 1.0), ("q", "/b/y", 1, 0.5), ("r", "/b/y", 1, 0.5)]
    assert "hashpartitioning(query_id" not in ranked._jdf.queryExecution().executedPlan().toString()
    assert S.rank_by_terms(pairs, terms.limit(0), None).count() == 0


def test_lists_are_kept_by_block_and_packed(spark, make_files, monkeypatch):
    monkeypatch.setattr(GI, "BLOCK_DOCUMENTS", 16, raising=False)
    contents = {f"/d/{i}": f"the same words {'other' if i % 3 else ''} and 漢 {i}" for i in range(200)}
    folder = scratch_path(spark, "gram-test")
    GI.write_gram_index(make_files(contents).coalesce(1), folder)
    grams = {t[i : i + n] for t in contents.values() for n in (1, 2, 3) for i in range(len(t) - n + 1) if " " not in t[i : i + n]}
    assert spark.read.parquet(f"{folder}/postings").count() <= 13 * len(grams)
    rows = sorted(values(GI.valid_postings(spark, folder).select("path", "gram", "bucket")))
    assert rows == sorted(values(GI.document_grams(make_files(contents)).select("path", "gram", "bucket")))
    # a merged index that grows and is merged again
    gone, states = spark.createDataFrame([(p,) for p in list(contents)[::7]], "path string"), [folder]
    left = {p: c for i, (p, c) in enumerate(contents.items()) if i % 7}
    for _ in range(2):
        GI.update_gram_index(make_files(left), gone, states[-1])
        states.append(scratch_path(spark, "gram-test"))
        GI.compact(spark, states[-2], states[-1])
        left |= {f"/new/{len(states)}": "wholly new words"}
        gone = spark.createDataFrame([(f"/new/{len(states)}",), ("/d/3",)], "path string")
    kept = {p: c for p, c in left.items() if p != "/new/3"}
    assert sorted(values(GI.valid_postings(spark, states[-1]).select("path", "gram"))) == sorted(
        values(GI.document_grams(make_files(kept)).select("path", "gram"))
    )


def test_paths_that_repeat_or_are_null(spark, make_files, monkeypatch):
    """Numbers and joins find the same, also where a path has several contents or none."""
    files = make_files({"/a": "alpha beta", "/b": "alphabet", "/c": "gam ma", "/n": "alpha al", "/e": ""}).unionByName(
        make_files({"/b": "alphabet", "/c": "gamma be", "/a": "none", "/o": "be gamma"}))
    files = files.selectExpr("nullif(path, '/n') AS path", "nullif(content, '') AS content")
    folder = scratch_path(spark, "gram-test")
    GI.write_gram_index(files, folder)
    GI.update_gram_index(files, spark.createDataFrame([("/o",), ("/o",), (None,)], "path string"), folder)

    def check(*queries):
        table = spark.createDataFrame([(f"q{i}", q, s) for i, (q, s) in enumerate(queries)], "query_id string, query string, scope string")
        found = lambda: sorted(values(GI.stored_substring_found(folder, files, table), "query_id", "path", "matched", "rank"), key=str)
        with monkeypatch.context() as m:
            m.setattr(GI, "_small_terms", lambda terms: None, raising=False)
            want = found()
        assert found() == want and want
        return want

    assert ("q0", "/a", 2, 2 / 3) in check(("alpha beta zzz", "/"), ("gamma al be", "/"), ("lphabe", "/b"), ("a", "/o"))
    assert {r[1] for r in check(("al", "/"))} == {"/a", None}
