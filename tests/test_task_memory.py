"""What one task holds does not follow the input."""

from collections import Counter

import pyarrow as pa
from leafmill.functions import lexemes as L
from leafmill.streaming import dirty as D
from test_streaming import log


def test_tasks_of_bursts_follow_the_log(spark, monkeypatch):
    rows = log(spark, *((3 * i, f"/d/{i % 50}") for i in range(400)))
    want = sorted(map(tuple, D.bursts(rows).collect()))
    monkeypatch.setattr(D, "TASK_SLOTS", 20, raising=False)
    got = D.bursts(rows).selectExpr("*", "spark_partition_id() as task").collect()
    assert sorted(tuple(r)[:-1] for r in got) == want
    by_task = Counter(r.task for r in got)
    assert len(by_task) > 20


def test_english_tokens_are_stemmed_in_steps(monkeypatch):
    monkeypatch.setattr(L, "STEP_TOKENS", 4, raising=False)
    monkeypatch.setattr(L, "MOST_STEMS", 2, raising=False)
    held, of = [], L._stems_of
    monkeypatch.setattr(L, "_stems_of", lambda rows, stems: held.append(len(rows.flatten())) or of(rows, stems))
    rows = [["the", "running"], None, [], ["dogs", "skies"], ["a", "b", "dogs", "dogs", "dogs", "the"], ["running"]]
    got = pa.concat_arrays(list(L._english.func(iter([pa.array(rows), pa.array(rows[3:]), pa.array([], pa.list_(pa.string()))]))))
    want = [None if r is None else [L.stem(t) for t in r if t not in L.STOP_WORDS] for r in rows]
    assert got.to_pylist() == want + want[3:]
    assert max(held) == 6 and len(held) >= 6
