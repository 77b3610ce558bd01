"""The limit of frequent lines does not grow with the host."""

from leafmill.llm import quality


def test_a_large_host_loses_the_same_lines_as_a_small_one(spark):
    own = lambda i: " ".join(f"w{i}x{k}" for k in range(50))
    texts = [own(i) + ("\nsubscribe to our letter" if i < 25 else "") for i in range(3000)]
    rows = [(i, host, t) for host, n in (("small", 30), ("large", 3000)) for i, t in enumerate(texts[:n])]
    got = quality.cleaned(spark.createDataFrame(rows, "doc_id long, source string, text string")).collect()
    assert len(got) == len(rows)
    for host in ("small", "large"):
        assert [r.doc_id for r in got if r.source == host and "subscribe" in r.text] == [0]
