"""Lexemes are counted in steps of bounded size, whatever texts come together."""

from collections import Counter

from conftest import values
from leafmill.functions import text as X
from leafmill.operators import index as I


def test_counts_do_not_depend_on_steps(spark, make_files, monkeypatch):
    monkeypatch.setattr(I, "LEXEMES_AT_ONCE", 5, raising=False)
    contents = {"/a": "one two one\nTWO one", "/b": "", "/c": "... !", "/d": "漢字 word 漢", "/e": " ".join(f"w{i % 7}" for i in range(40)), "/f": "one"}
    found = I.text_postings(make_files(contents), "zh")
    assert "sort_array" not in found._jdf.queryExecution().optimizedPlan().toString()
    words = {p: Counter(c.lower().replace("\n", " ").split() + [p[1], "{}"[2:]]) for p, c in contents.items() if p in ("/a", "/e", "/f")}
    rows = values(found, "path", "source", "kind", "lexeme", "tf")
    assert {(p, w): n for p, _, _, w, n in rows if p in words} == {(p, w): n for p, c in words.items() for w, n in c.items() if w}
    assert {(w, n) for p, _, _, w, n in rows if p == "/d"} == {("d", 1), ("漢", 2), ("字", 1), ("漢字", 1), ("word", 1)}
    assert {r[1:3] for r in rows} == {("text", "file")} and len(rows) == len({(r[0], r[3]) for r in rows})
    stems = values(I.text_postings(make_files({"/x": "running the runs", "/y": "the"}), "en"), "path", "lexeme", "tf")
    assert sorted(stems) == [("/x", "run", 2), ("/x", "x", 1), ("/y", "y", 1)]


def test_no_han_character_comes_before_the_first_that_is_looked_at(spark):
    signs = spark.range(0x80, 0x2E80).selectExpr("decode(unhex(lpad(hex(id), 8, '0')), 'UTF-32') AS sign")
    assert signs.filter(signs.sign.rlike(X._HAN)).count() == 0
    han = spark.createDataFrame([(c,) for c in "⺀々〇〡㐀一龥豈𠀀"], "sign string")
    assert han.filter(han.sign.rlike(X._MAYBE_HAN) & han.sign.rlike(X._HAN)).count() == 9
