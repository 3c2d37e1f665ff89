"""Every registered query with SQL against that SQL, on the smallest tables."""

import pytest
from compare import difference, duck

import __spark_entry__ as entry

SMALL = "/root/testdata/sf0.001"
SQL = entry.oracle_sql()
# the wide dummies are written for all levels, which the smallest tables may lack
NAMES = sorted(SQL)


@pytest.fixture(scope="module")
def con():
    return duck(SMALL)


def test_every_sql_has_a_query():
    assert set(SQL) <= set(entry.queries())


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, con, name):
    got = entry.queries()[name](spark, SMALL).toPandas()
    assert difference(got, con.execute(SQL[name]).df()) is None


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["order_region", "n", "rate"] and df.count() == 25
