"""Trimming cuts all Unicode white space, in time that follows the text."""

import time

from leafmill.functions import text as X
from pyspark.sql import functions as F


def test_trim_equals_the_pattern(spark):
    blank = [(i, chr(i) + "a" + chr(i) + "b" + chr(i)) for i in range(1, 0x3100)] + [(0, ""), (-1, " 　\t"), (-2, None), (-3, "\n 港 \r\n")]
    rows = spark.createDataFrame(blank, "i int, t string")
    pattern = F.regexp_replace("t", r"\A\p{IsWhite_Space}+|\p{IsWhite_Space}+\z", "")
    assert rows.filter(~X.trim("t").eqNullSafe(pattern)).count() == 0
    assert rows.filter("i > 0").filter(F.length(X.trim("t")) == 3).count() == 25


def test_trim_of_long_runs(spark):
    rows = spark.range(1).select(F.concat(F.lit("a"), F.repeat(F.lit(" "), 300_000), F.lit("b ")).alias("t"))
    began = time.time()
    assert rows.select(F.length(X.trim("t"))).first()[0] == 300_002
    assert time.time() - began < 20
