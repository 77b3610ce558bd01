"""Registered queries against their SQL on the given tables.

All of them run with LEAFMILL_ALL_QUERIES=1; without it, one or two of each family.
"""

import math
import os
from decimal import Decimal

import pytest

duckdb = pytest.importorskip("duckdb")

from leafmill.plans import ORACLES, QUERIES  # noqa: E402

FOLDER = os.environ.get("LEAFMILL_TEST_DATA", "/root/testdata/sf0.001")
TABLES = "documents pages benchmark labels conversations events".split()
SAMPLE = (
    "source_build source_history_documents path_ancestors tree_lines find_page glob_paths grep_context view_line_table "
    "text_passages text_metadata index_text search_top_documents search_passages write_outcomes summary_rollup "
    "stream_bursts question_selection trace_measure"
).split()
NAMES = list(QUERIES) if os.environ.get("LEAFMILL_ALL_QUERIES") else SAMPLE

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="the given tables are not here")


@pytest.fixture(scope="module")
def sql():
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'")
    return connection


def plain(value):
    if isinstance(value, (float, Decimal)):
        value = float(value)
        return None if math.isnan(value) else round(value, 9)
    return float(value) if isinstance(value, int) and not isinstance(value, bool) else value


def table(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=lambda r: tuple(map(str, r)))


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, sql, name):
    df = QUERIES[name](spark, FOLDER)
    got = table(df.columns, df.collect())
    if name not in ORACLES:
        assert got
        return
    cursor = sql.execute(ORACLES[name])
    columns = [d[0] for d in cursor.description]
    assert sorted(columns) == sorted(df.columns)
    assert got == table(columns, cursor.fetchall())


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES) and len(QUERIES) > 100
