import sys
from datetime import datetime, timedelta
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from leafmill.session import local_session  # noqa: E402
from leafmill.sources import corpus as C  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(8, 4)
    session.sparkContext.setLogLevel("ERROR")
    return session


@pytest.fixture(scope="session")
def make_files(spark):
    """A files table from {path: content}."""

    def make(contents: dict):
        rows = [
            (path, content, datetime(2024, 1, 1) + timedelta(minutes=i))
            for i, (path, content) in enumerate(contents.items())
        ]
        return C.with_file_columns(
            spark.createDataFrame(rows, "path string, content string, mtime timestamp")
        )

    return make


def values(df, *columns):
    rows = df.select(*columns).collect() if columns else df.collect()
    return [tuple(r) if len(r) > 1 else r[0] for r in rows]
