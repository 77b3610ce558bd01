"""The pipeline, stage after stage, against plain restatements on the smallest given table."""

import brute_personal
import public_tokenizers
import pytest
from test_near_duplicates import plain
from test_text_operators import plain_quality
from tokenizers import Tokenizer

import corpus_pipeline
from leafmill.llm import quality
from leafmill.session import durable

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        out.append(durable(stage(spark, out[-1], FOLDER), name.replace(" ", "-")))
    return out


def rows_of(df):
    return {r.doc_id: r for r in df.collect()}


def test_stages_keep_the_columns(stages):
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality rules", "near-duplicates", "personal data", "packing"]
    for df in stages[1:-1]:
        assert df.columns == stages[0].columns and df.dtypes == stages[0].dtypes


def test_quality_stage(stages):
    before, after = rows_of(stages[0]), rows_of(stages[1])
    limits = quality.LIMIT_DOCUMENTS, 0, quality.LEFT_PERCENT
    want = plain_quality([(i, r.source, r.text) for i, r in before.items()], *limits)
    assert set(after) == {i for i, v in want.items() if v[-1]}
    assert all(after[i] == before[i] for i in after)


def test_duplicate_stage(stages):
    before, after = rows_of(stages[1]), rows_of(stages[2])
    _, root = plain([(i, r.text) for i, r in before.items()], corpus_pipeline.NEAR_PERCENT)
    assert set(after) == {i for i in root if root[i] == i}
    assert all(after[i] == before[i] for i in after)


def test_personal_stage(stages):
    before, after = rows_of(stages[2]), rows_of(stages[3])
    assert set(after) == set(before)
    for i, row in after.items():
        assert not brute_personal.base(row.text) and row.n_chars == len(row.text)
        if not brute_personal.base(before[i].text):
            assert row.text == before[i].text or "[" in row.text


def test_packing_stage(stages):
    whole = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = {i: r.text for i, r in rows_of(stages[3]).items()}
    found, sequences = {}, {}
    for r in stages[4].collect():
        found.setdefault(r.doc_id, []).append((r.start, memoryview(bytes(r.ids)).cast("I").tolist()))
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert set(found) == set(texts)
    for i, text in texts.items():
        ids = [*whole.encode(text, add_special_tokens=False).ids, 0]
        assert [x for _, part in sorted(found[i]) for x in part] == ids
    for number, parts in sequences.items():
        assert sum(n for _, n in parts) == 1024 or number == max(sequences)
