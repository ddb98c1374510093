"""Every registered query against its SQL on the smallest driver tables."""

import os

import pytest

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables not present")

import __spark_entry__ as contract  # noqa: E402
import compare  # noqa: E402


@pytest.fixture(scope="module")
def con():
    import duckdb

    made = duckdb.connect()
    for table in compare.TABLES:
        made.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    return made


NAMES = sorted(make.__name__ for make in contract.QUERIES)


def test_every_query_has_sql():
    assert set(NAMES) <= set(contract.queries()) and set(NAMES) <= set(contract.oracle_sql())


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, con, name):
    df = contract.queries()[name](spark, SF)
    result = con.execute(contract.oracle_sql()[name])
    columns = [d[0] for d in result.description]
    assert sorted(df.columns) == sorted(columns)
    got = compare._rows(df.columns, [tuple(r) for r in df.collect()])
    assert got == compare._rows(columns, result.fetchall())


def test_entry(spark):
    assert contract.entry(spark).count() > 0
