"""Every registered query against its SQL in DuckDB, on the smallest data."""

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

import __spark_entry__ as entry

duckdb = pytest.importorskip("duckdb")
SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="test data not present")


@pytest.fixture(scope="module")
def con():
    from tools.check_oracle import TABLES

    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and "session_id" in df.columns


@pytest.mark.parametrize("name", list(entry.queries()))
def test_query(spark, con, name):
    from tools.check_oracle import normal

    df = entry.queries()[name](spark, SF)
    got = normal(df.columns, [tuple(r) for r in df.collect()])
    sql = entry.oracle_sql().get(name)
    if sql is None:
        assert got[1]
        return
    result = con.execute(sql)
    assert got == normal([d[0] for d in result.description], result.fetchall())
