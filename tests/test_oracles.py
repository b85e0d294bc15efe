"""Every registered query against its SQL on the smallest tables."""

from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
import check_queries

SF = "/root/testdata/sf0.001"
NAMES = [n for n in entry.queries() if not n.startswith("op") and n != "pipeline"]  # those are compared in tests/llm


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for path in Path(SF).glob("*.parquet"):
        c.execute(f"create view {path.stem} as select * from '{path}'")
    return c


@pytest.mark.skipif(not Path(SF).exists(), reason="supplied tables not present")
@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, con, name):
    text, _, ok = check_queries.compare(spark, con, name, SF)
    assert ok, text


def test_contract():
    assert set(entry.oracle_sql()) <= set(entry.queries())
