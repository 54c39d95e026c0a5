"""Every query that has SQL, against DuckDB on the smallest tables."""

from pathlib import Path

import duckdb
import pytest

from bitmesh.plans import catalog

SF = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not SF.exists(), reason="test tables are not there")


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for f in SF.glob("*.parquet"):
        con.sql(f"create view {f.stem} as select * from '{f}'")
    return con


def same(df, relation):
    names = sorted(df.columns)
    assert names == sorted(relation.columns)
    at = [relation.columns.index(n) for n in names]
    order = lambda row: [(v is None, str(v)) for v in row]
    assert sorted((tuple(r) for r in df.select(*names).collect()), key=order) == sorted((tuple(r[i] for i in at) for r in relation.fetchall()), key=order)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query(spark, db, name):
    same(catalog.queries()[name](spark, str(SF)), db.sql(catalog.oracle_sql()[name]))


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 230
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
