"""Texts without frequent lines, and rows without id, in the quality stage."""

from leafmill.llm import quality

FIELDS = "doc_id long, source string, text string, n_chars long, gone string"


def own(i, n=60):
    return " ".join(f"w{i}x{k}" for k in range(n))


def test_frequent_lines_leave_the_texts(spark):
    rows = [(i, "h", f"{own(i)}\n  Read\tMORE here\n\nend {i}") for i in range(30)]
    rows += [(100, "other", rows[3][2]), (None, "h", f"read more here\n{own(200)}"), (None, "h", own(201)), (None, "h", "short")]
    rows += [(101, None, None)]
    df = spark.createDataFrame([(*r, len(r[2] or ""), "q") for r in rows], FIELDS).repartition(3)
    got = quality.cleaned(df)
    assert got.columns == df.columns and got.dtypes == df.dtypes
    want = {(0, rows[0][2]), (100, rows[3][2]), (None, own(200)), (None, own(201))}
    want |= {(i, f"{own(i)}\n\nend {i}") for i in range(1, 30)}
    out = got.collect()
    assert {(r.doc_id, r.text) for r in out} == want and len(out) == len(want)
    assert all(r.n_chars == len(r.text) and r.gone == "q" for r in out)
    kept = quality.keep_good(df).collect()
    assert {(r.doc_id, r.text) for r in kept} == {(i, t) for i, _, t in rows if t and t != "short"}
