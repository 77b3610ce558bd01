"""Candidates of a table of patterns: nothing is moved for patterns that can be broadcast, and the other way agrees."""

import random

from conftest import values

from leafmill.operators import pattern_table as PT
from leafmill.operators.evaluate import containing_documents


def test_documents_are_not_moved_and_both_ways_agree(spark, make_files, monkeypatch):
    draw = random.Random(3)
    text = lambda n: "".join(draw.choice("abA ſ") for _ in range(n))
    contents = {f"/d{i}": "\n".join(text(draw.randrange(60)) for _ in range(3)) for i in range(40)}
    cut = lambda c: c[(at := draw.randrange(len(c))) : at + draw.randrange(1, 16)].split("\n")[0]
    rows = sorted({(cut(c), i % 2 == 0) for i, c in enumerate(list(contents.values()) * 4) if c.strip()} - {("", True), ("", False)})
    files, table = make_files(contents), spark.createDataFrame(rows, "pattern string, ignore_case boolean")
    low = lambda t, ignore: t.lower() if ignore else t
    model = {(p, ignore, path, n) for p, ignore in rows for path, c in contents.items()
             for n, line in enumerate(c.split("\n"), 1) if low(p, ignore) in low(line, ignore)}
    needles = spark.createDataFrame(list(enumerate(sorted({p for p, _ in rows}))), "needle_id long, needle string")
    held = {(i, path) for i, p in needles.collect() for path, c in contents.items() if p in c}

    def check():
        found = PT.grep_table(files, table)
        got = values(found, "pattern", "ignore_case", "path", "line")
        assert set(got) == model and len(got) == len(model)
        assert set(values(containing_documents(files, needles), "needle_id", "path")) == held
        return found._jdf.queryExecution().executedPlan().toString()

    assert "hashpartitioning(path" not in check()
    monkeypatch.setattr(PT, "MOST_KEYS", 5)
    check()


def test_texts_are_found_where_documents_are(spark, make_files, monkeypatch):
    """Both ways give each pair once: beside the documents, and by keys for more texts than a task takes."""
    from leafmill.operators import evaluate as E

    files = make_files({f"/{n}.md": f"naïve tea {n % 3} — line\nof 漢字 text {'x' * n} end" for n in range(12)}).unionByName(
        make_files({"/long.md": "abab" * 400_000 + " tail of it all"})
    )
    texts = ["tea 1 — line", "naïve", "字 text", "xxx end", "abab tail of it", "not here", "tea 1 — line", "é"]
    needles = spark.createDataFrame([*enumerate(texts), (99, None)], "needle_id long, needle string")
    want = sorted((n, r.path) for r in files.collect() for n, t in enumerate(texts) if t in r.content)
    found = E.containing_documents(files, needles)
    assert sorted(values(found, "needle_id", "path")) == want
    assert "MapInArrow" in found._jdf.queryExecution().optimizedPlan().toString()
    monkeypatch.setattr(E, "MOST_TEXTS", 2)
    assert sorted(values(E.containing_documents(files, needles.filter("needle is not null")), "needle_id", "path")) == want
