"""Registered queries: names, and their SQL on the smallest given tables."""

import datetime
import math

import pytest

duckdb = pytest.importorskip("duckdb")

import __spark_entry__ as entry  # noqa: E402
from leafmill import llm  # noqa: E402

FOLDER = "/root/testdata/sf0.001"


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 9)
    return str(value) if isinstance(value, datetime.datetime) else value


def table(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=lambda r: tuple(map(str, r)))


@pytest.mark.parametrize("name", sorted(llm.ORACLES))
def test_query_equals_sql(spark, name):
    connection = duckdb.connect()
    for given in ("documents", "pages", "conversations"):
        connection.execute(f"CREATE VIEW {given} AS SELECT * FROM '{FOLDER}/{given}.parquet'")
    df = llm.QUERIES[name](spark, FOLDER)
    cursor = connection.execute(llm.ORACLES[name])
    columns = [d[0] for d in cursor.description]
    assert sorted(columns) == sorted(df.columns)
    assert table(df.columns, df.collect()) == table(columns, cursor.fetchall())


def test_registered_queries():
    names = [n.split("_")[0] for n in llm.QUERIES]
    assert sorted(names) == sorted(f"op{i}" for i in range(1, 14))
    assert set(llm.QUERIES) | {"pipeline"} <= set(entry.queries())
