"""The share of the near-duplicate stage."""

from test_near_duplicates import sets_of

import corpus_pipeline
from leafmill.llm import near_duplicates


def test_near_copies_from_80_percent_leave(spark):
    words = [f"b{i}" for i in range(200)]
    rows = []
    for i, changed in enumerate((0, 4, 7)):
        text = list(words)
        text[20 : 20 + 20 * changed : 20] = [f"c{i}x{k}" for k in range(changed)]
        rows.append((i, " ".join(text)))
    a, b, c = (sets_of(t) for _, t in rows)
    assert 0.80 <= len(a & b) / len(a | b) < 0.85 and max(len(x & c) / len(x | c) for x in (a, b)) < 0.80
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.doc_id for r in corpus_pipeline.near_duplicates(spark, df, "").collect()) == [0, 2]


def test_texts_of_one_id_all_stay(spark):
    texts = {k: " ".join(f"{k}{i}" for i in range(60)) for k in "abc"}
    near = {k: t + " more" for k, t in texts.items()}
    rows = [(1, texts["a"]), (1, texts["b"]), (1, texts["b"]), (2, near["a"]), (3, near["b"]), (4, texts["c"])]
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], "doc_id long, text string, _gone string, _gone0 string")
    got = near_duplicates.one_of_each(df, 80)
    assert got.columns == df.columns
    assert sorted((r.doc_id, r.text) for r in got.collect()) == sorted({rows[0], rows[1], rows[5]})
