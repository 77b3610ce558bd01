"""The table of patterns against a line-by-line model."""

import random
import re

import pytest
from conftest import values

from leafmill.functions.patterns import required_literal
from leafmill.operators import pattern_table as PT
from leafmill.operators.errors import InvalidParameter

SCHEMA = "pattern string, regex boolean, ignore_case boolean, whole_word boolean, whole_line boolean, extra string"
CONTENTS = {
    "/a.txt": "The cat sat\non a mat.\n\nCATALOGUE 42", "/b/c.txt": "cat\ndog 7\nKelvin K ſet\nİd ß", "/b/.hidden": "cat in hiding",
    "/empty": "", "/long": "x" * 50_000 + "needle" + "é😀z" * 2000,
}


def model(contents, patterns):
    """Distinct rows (pattern, flags, path, line); flags that are None are false."""
    out = set()
    for pattern, *flags in {(p, *(bool(f) for f in fs)) for p, *fs, _ in patterns if p is not None}:
        regex, ignore, word, whole = flags
        body = pattern if regex else re.escape(pattern.lower() if ignore else pattern)
        if word:
            body = rf"(?a:\b){body}(?a:\b)" if regex else (r"(?<![0-9A-Za-z_])" if re.match(r"[0-9A-Za-z_]", pattern) else "") + body + (
                r"(?![0-9A-Za-z_])" if re.search(r"[0-9A-Za-z_]\Z", pattern) else "")
        if whole:
            body = rf"^{body}$" if regex else rf"\A{body}\Z"
        test = re.compile(body, re.I if regex and ignore else 0)
        for path, content in contents.items():
            for n, line in enumerate(content.split("\n"), 1):
                if test.search(line.lower() if ignore and not regex else line):
                    out.add((pattern, *flags, path, n))
    return out


def found(files, patterns, **options):
    rows = values(PT.grep_table(files, patterns, **options), "pattern", *PT.FLAGS, "path", "line")
    assert len(rows) == len(set(rows))
    return set(rows)


def test_kinds_of_patterns(spark, make_files):
    patterns = [
        ("cat", None, None, None, None, "x"), ("cat", None, None, None, None, "y"), ("CAT", False, True, None, None, None), ("cat", False, False, True, None, None),
        ("cat", False, False, False, True, None), ("c.t", True, True, False, False, None), ("c.t", True, False, True, False, None), ("^on|dog", True, False, False, False, None),
        ("[0-9]+", True, False, False, False, None), ("k", True, True, False, False, None), ("set", True, True, False, False, None), ("", False, False, False, True, None),
        (None, False, False, False, False, None), ("needleé😀", False, False, False, False, None), ("😀z", False, True, False, False, None), ("absent words", False, False, False, False, None),
        ("a+t.?", True, False, False, False, None), (".", False, False, False, False, None), ("t\\.$", True, False, False, False, None),
    ]
    files = make_files(CONTENTS)
    table = spark.createDataFrame(patterns, SCHEMA)
    assert found(files, table, show_all=True) == model(CONTENTS, patterns)
    shown = {k: v for k, v in CONTENTS.items() if k != "/b/.hidden"}
    assert found(files, table) == model(shown, patterns)
    assert found(files, table, path="/b") == model({"/b/c.txt": CONTENTS["/b/c.txt"]}, patterns)
    assert found(files, table.limit(0)) == set() and found(files.limit(0), table) == set()


def test_random_patterns(spark, make_files):
    draw = random.Random(8)
    text = lambda n: "".join(draw.choice("abAB .1") for _ in range(n))
    contents = {f"/d{i}": "\n".join(text(draw.randrange(25)) for _ in range(4)) for i in range(40)}
    parts = ["a", "b", "A", "ab", "B.", "1?", "a*", "b+", "(ab|1)", "[ab]", "a{2}", "b{0,1}", r"\.", "^", "$", r"\b", "(?:a)?"]
    rows = [(text(draw.randrange(1, 7)), False, *(draw.random() < 0.3 for _ in range(3)), None) for _ in range(150)]
    rows += [("".join(draw.choice(parts) for _ in range(draw.randrange(1, 6))), True, *(draw.random() < 0.3 for _ in range(3)), None) for _ in range(250)]
    good = []
    for row in rows:
        try:
            re.compile(row[0] if row[1] else "")
            if not re.search(r"[*+?}][*+?{]|(^|[\^$(])[*+?{]|\\b[*+?{]", row[0]) or not row[1]:
                good.append(row)
        except re.error:
            pass
    assert len(good) > 250
    assert found(make_files(contents), spark.createDataFrame(good, SCHEMA)) == model(contents, good)


def test_every_match_holds_the_literal():
    draw = random.Random(9)
    for _ in range(3000):
        pattern = "".join(draw.choice(["a", "b", "c?", "a*", "b+", "(ab)", "[ab]", "b{1,2}", "c{0}", r"\.", "(a|b)", "a|b"]) for _ in range(5))
        literal, test = required_literal(pattern), re.compile(pattern)
        for _ in range(5):
            hit = test.search("".join(draw.choice("abc.") for _ in range(12)))
            assert hit is None or literal in hit[0]


def test_plan_does_not_grow_with_the_patterns(spark, make_files):
    files = make_files(CONTENTS)

    def plan(n):
        table = spark.createDataFrame([(f"cat{i}" if i else "cat",) for i in range(n)], "pattern string")
        return len(PT.grep_table(files, table)._jdf.queryExecution().optimizedPlan().toString())

    assert abs(plan(2) - plan(1000)) < 200


def test_wrong_and_repeated_checks(spark, make_files):
    files = make_files(CONTENTS)
    with pytest.raises(InvalidParameter):
        PT.grep_table(files, spark.createDataFrame([("a(?=b)", True)], "pattern string, regex boolean"))
    checks = spark.createDataFrame([("a", "^THE"), ("a", "^THE"), ("b", "zebra"), ("c", None)], "label string, pattern string")
    assert sorted(values(PT.check_table(files, checks), "label", "status")) == [("a", "PASS"), ("a", "PASS"), ("b", "FAIL"), ("c", "FAIL")]


def test_texts_without_inner_words_meet_documents(spark, make_files):
    from leafmill.operators.evaluate import containing_documents

    files = make_files({"/a": "one two three four", "/b": "漢字\nx!", "/c": "", "/d": "xx two thre"})
    needles = [(1, "two three four"), (2, "漢字\nx"), (3, "x"), (4, "two"), (5, ""), (6, "none here at all"), (7, "x"), (8, "#")]
    got = values(containing_documents(files, spark.createDataFrame(needles, "needle_id long, needle string")), "needle_id", "path")
    texts = {r.path: r.content for r in files.collect()}
    assert sorted(got) == sorted((i, path) for i, n in needles for path, text in texts.items() if n in text)
    only = spark.createDataFrame([(1, "字\nx")], "needle_id long, needle string")
    assert values(containing_documents(files, only), "needle_id", "path") == [(1, "/b")]


def test_passes_and_batches_find_the_same(spark, make_files, monkeypatch):
    """Neither the number of passes over the documents nor the size of a step changes what is found, and nothing is moved."""
    monkeypatch.setattr(PT, "PASS_KEYS", 20, raising=False)
    monkeypatch.setattr(PT, "MOST_KEYS", 5)
    monkeypatch.setattr(PT, "_BYTES_AT_ONCE", 64, raising=False)
    monkeypatch.setattr(PT, "_HITS_AT_ONCE", 7, raising=False)
    draw = random.Random(11)
    text = lambda n: "".join(draw.choice("abÄ ſ漢1.") for _ in range(n))
    contents = {f"/d{i}": "\n".join(text(draw.randrange(30)) for _ in range(5)) for i in range(30)} | {"/e": "", "/f": "\n\n" + "ab" * 300}
    patterns = [(text(draw.randrange(1, 11)), False, draw.random() < 0.5, False, False, None) for _ in range(90)]
    patterns += [("ab" * n, False, False, False, False, None) for n in (4, 5, 40, 300)] + [("a\nb", False, False, False, False, None)]
    files = make_files(contents).unionByName(make_files({"/none": "x"}).selectExpr("path", "title", "CAST(NULL AS string) AS content", "size", "mtime", "content_hash", "revision"))
    found_by = PT.grep_table(files, spark.createDataFrame(patterns, SCHEMA))
    rows = values(found_by, "pattern", *PT.FLAGS, "path", "line")
    assert set(rows) == model(contents, patterns) and len(rows) == len(set(rows))
    assert "Exchange" not in found_by._jdf.queryExecution().optimizedPlan().toString()
    plan = found_by._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(path" not in plan and "hashpartitioning(gram" not in plan
    texts = {(r.path, r.line): r.text for r in found_by.collect()}
    assert all(contents[path].split("\n")[line - 1] == line_text for (path, line), line_text in texts.items())


def test_a_check_that_passed_is_not_looked_for_again(spark, make_files, monkeypatch):
    files = make_files({f"/d{i}": f"always here\nrare{i} word" for i in range(150)})
    asked, of = [], PT.grep_table
    monkeypatch.setattr(PT, "grep_table", lambda part, patterns, **o: asked.append((part.count(), patterns.distinct().count())) or of(part, patterns, **o))
    rows = [("a", "^always"), ("b", "rare77 w"), ("c", "here$"), ("d", "absent"), ("e", "^r.*[0-9]+ ")]
    checks = spark.createDataFrame(rows, "label string, pattern string")
    assert sorted(values(PT.check_table(files, checks), "label", "status")) == [("a", "PASS"), ("b", "PASS"), ("c", "PASS"), ("d", "FAIL"), ("e", "PASS")]
    assert sum(n for n, _ in asked) == 150 and asked[0][1] == 5 and asked[-1][1] <= 2
