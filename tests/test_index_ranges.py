"""Tasks that write an index hold about as many rows as a file, however the lexemes are spread."""

from collections import Counter

from conftest import values
from leafmill.operators import index as I


def test_no_task_of_the_writer_holds_several_files(spark, tmp_path):
    rows = [(f"/d/{i}.md", "text", "file", word, 1) for i in range(40) for word in ["always", *(f"w{i * 13 % 97 + j}" for j in range(9))]]
    postings = spark.createDataFrame(rows, "path string, source string, kind string, lexeme string, tf int")
    I.write_index(postings, str(tmp_path / "index"), rows=20)
    stored = I.read_index(spark, str(tmp_path / "index"))
    assert sorted(values(stored.select(postings.columns))) == sorted(rows)
    files = [r[0] for r in stored.selectExpr("input_file_name()").collect()]
    tasks = Counter(name.rsplit("/part-", 1)[1][:5] for name in files)
    assert len(tasks) >= 18 and max(tasks.values()) <= 30
