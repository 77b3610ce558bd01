"""What the generators of personal data propose."""

from pyspark.sql import functions as F

from leafmill.llm import personal_data

PROPOSED = {
    "phone": ["5551234567", "0176 12345678", "01 23 45 67 89", "(0176)12345678", "555-1234", "030/1234567", "020 7946-0958", "123456789012345"],
    "ip": ["fe80::1", "::1", "2001:db8::", "2001:db8::8a2e:370:7334", "abcd::ef", "::ffff:192.0.2.128", "1:2:3:4:5:6:7:8", "10.0.0.1"],
}
NOT_PROPOSED = {"phone": ["123456", "1234567890123456", "a1234567", "12345678b"], "ip": ["std::vector", "a :: b", "12:30", "::"]}


def test_generators_propose_all_spellings(spark):
    rows = [(k, t, f"so {t}, or", True) for k, ts in PROPOSED.items() for t in ts]
    rows += [(k, t, f"so {t}, or", False) for k, ts in NOT_PROPOSED.items() for t in ts]
    df = spark.createDataFrame(rows, "kind string, span string, text string, wanted boolean")
    for kind in PROPOSED:
        found = df.filter(F.col("kind") == kind).withColumn("c", personal_data.candidates(F.col("text"), kind)).collect()
        for r in found:
            spans = [r.text[c.s : c.e] for c in r.c]
            assert (r.span in spans) if r.wanted else not spans, (r.span, spans)


def test_texts_without_digits_are_looked_at(spark):
    row = personal_data.found(spark.createDataFrame([(1, "so abcd::ef, or")], "doc_id long, text string")).first()
    assert [(c.kind, c.s, c.e) for c in row.wide] == [("ip", 3, 11)]
