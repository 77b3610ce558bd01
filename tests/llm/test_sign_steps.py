"""Signing takes texts in small steps, with the same signatures as in one."""

import pyarrow as pa
from leafmill.llm import common as C
from leafmill.llm import near_duplicates as N


def test_steps_are_small_and_change_nothing(monkeypatch):
    texts = [" ".join(f"w{i * j % 701}" for j in range(i % 900)) for i in range(400)] + [None, ""]
    batch = pa.record_batch([pa.array(range(len(texts))), pa.array(texts)], names=["doc_id", "text"])
    parts = list(N._sign(iter([batch])))
    assert max(sum(len(t or "") for t in texts[p.column(0)[0].as_py() : p.column(0)[-1].as_py() + 1]) for p in parts) < 1 << 18
    monkeypatch.setattr(N, "text_steps", lambda batches, step: C.text_steps(batches, 1 << 30))
    assert pa.Table.from_batches(parts).to_pydict() == pa.Table.from_batches(list(N._sign(iter([batch])))).to_pydict()
