"""Every query with SQL against DuckDB on the smallest tables; the others must run."""

import pytest

import __spark_entry__
from granary.plans import catalog

duckdb = pytest.importorskip("duckdb")
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents labels".split():
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def _rows(frame, columns):
    return sorted(map(str, frame[columns].astype(object).where(frame[columns].notna(), None).itertuples(index=False, name=None)))


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_query_equals_sql(spark, con, name):
    ours, theirs = __spark_entry__.queries()[name](spark, SF).toPandas(), con.execute(__spark_entry__.oracle_sql()[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert _rows(ours, sorted(ours.columns)) == _rows(theirs, sorted(ours.columns))


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.SQL)))
def test_query_runs(spark, name):
    assert catalog.QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
