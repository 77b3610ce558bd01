"""Streams against their batch forms."""

from datetime import datetime, timedelta

from conftest import values
from leafmill.operators import index as I
from leafmill.operators import mutate as M
from leafmill.streaming import changes as CH
from leafmill.streaming import dirty as D

START = datetime(2024, 1, 1)


def log(spark, *rows):
    return spark.createDataFrame([(START + timedelta(seconds=s), p) for s, p in rows], "ts timestamp, path string")


def test_bursts(spark):
    rows = log(spark, (0, "/d/1"), (0.5, "/d/2"), (1, "/d/3"), (3, "/d/4"), (5.0, "/d/5"), (7.5, "/d/1"))
    got = sorted((r.path, r.writes, (r.due - START).total_seconds()) for r in D.bursts(rows).collect())
    assert [g for g in got if g[0] == "/d"] == [("/d", 1, 9.5), ("/d", 5, 7.0)]
    assert [g for g in got if g[0] == "/d/1"] == [("/d/1", 1, 2.0), ("/d/1", 1, 9.5)]
    assert len([g for g in got if g[0] == "/"]) == 2


def stream_of(spark, folder, schema, *frames):
    for i, frame in enumerate(frames):
        frame.coalesce(1).write.parquet(f"{folder}/{i:03d}")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(folder))


def test_debounce_stream_equals_bursts(spark, tmp_path):
    first = log(spark, (0, "/d/1"), (1, "/d/2"), (2, "/d/3"))
    second = log(spark, (1.5, "/e"), (8, "/d/1"))
    closing = log(spark, (5000, "/z"), (5001, "/z"))
    late = log(spark, (5002, "/z"))
    stream = stream_of(spark, tmp_path / "in", "ts timestamp, path string", first, second, closing, late)
    query = (D.debounce(stream, lateness="0 seconds").writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "cp"))
             .option("path", str(tmp_path / "out")).trigger(availableNow=True).start())
    query.awaitTermination()
    got = {tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect() if r.path != "/z"}
    want = {tuple(r) for r in D.bursts(first.union(second).union(closing).union(late)).collect()}
    assert {g for g in got if g[1] < START + timedelta(seconds=100)} == {w for w in want if w[1] < START + timedelta(seconds=100)}


def test_dirty_jobs(spark, tmp_path):
    frames = [log(spark, (0, "/d/1"), (1, "/d/1")), log(spark, (2, "/d/2")), log(spark, (60, "/z")), log(spark, (61, "/z"))]
    stream = stream_of(spark, tmp_path / "in", "ts timestamp, path string", *frames)
    seen = []
    query = (D.dirty_jobs(stream, lateness="0 seconds").writeStream.outputMode("append").foreachBatch(lambda df, _: seen.extend(df.collect()))
             .option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start())
    query.awaitTermination()
    got = {(r.path, r.version, (r.last_write - START).total_seconds()) for r in seen}
    assert {("/d/1", 2, 1.0), ("/d/2", 1, 2.0), ("/d", 3, 2.0)} <= got
    assert len([r for r in seen if r.path == "/d"]) == 1


def test_ingest(spark, make_files, tmp_path):
    base = make_files({"/d/a.md": "alpha one", "/d/b.md": "beta", "/e/c.md": "gamma"})
    ts = datetime(2025, 1, 1)
    batches = [
        [(1, "put", "/d/a.md", "alpha two", None, None, None, None, ts), (2, "delete", "/e", None, None, None, None, None, ts)],
        [(3, "put", "/e/c.md", "delta", None, None, None, "*", ts), (4, "edit", "/d/a.md", None, "two", "three", None, None, ts)],
        [(5, "delete", "/d/b.md", None, None, None, None, None, ts), (6, "put", "/d/n.md", "new", None, None, None, None, ts), (7, "delete", "/e/c.md", None, None, None, None, None, ts)],
    ]
    frames = [spark.createDataFrame(rows, M.REQUEST_SCHEMA) for rows in batches]
    stream = stream_of(spark, tmp_path / "in", M.REQUEST_SCHEMA, *frames)
    folder = str(tmp_path / "table")
    CH.ingest(stream, base, folder, "en").awaitTermination()
    files = CH.current_files(base, folder)
    everything, _ = M.apply(base, frames[0].union(frames[1]).union(frames[2]))
    columns = ("path", "content", "revision", "content_hash")
    before = sorted(values(files, *columns))
    assert before == sorted(values(everything, *columns))
    postings = CH.current_postings(I.build_index(base, "en"), folder)
    assert sorted(values(postings)) == sorted(values(I.build_index(files, "en").select(postings.columns)))
    CH.ingest_batch(base, folder, frames[2], 2, "en")
    assert sorted(values(CH.current_files(base, folder), *columns)) == before
