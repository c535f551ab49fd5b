from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from mercato.schemas import TABLE_SPECS  # noqa: E402
from mercato.session import build_session  # noqa: E402
from mercato.sources.tables import Tables  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session(
        "mercato-tests",
        master="local[4]",
        spark__sql__shuffle__partitions=4,
        spark__default__parallelism=4,
        spark__driver__memory="4g",
        spark__ui__showConsoleProgress="false",
        spark__checkpoint__dir=tmp_path_factory.mktemp("checkpoint"),
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def make_tables(spark):
    """Input tables from short rows; columns not given are NULL, tables not given are empty."""

    def build(**rows: list[dict]) -> Tables:
        def frame(name: str):
            schema = TABLE_SPECS[name].schema
            data = [tuple(row.get(f.name) for f in schema) for row in rows.get(name, [])]
            return spark.createDataFrame(data, schema)

        return Tables(frame)

    return build
