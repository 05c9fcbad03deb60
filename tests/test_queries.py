"""Every named query against its SQL; queries without SQL must give rows."""

import pytest

import __spark_entry__ as entry
from compare import connect, difference

NAMES = sorted(entry.queries())


@pytest.fixture(scope="module")
def duck(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", NAMES)
def test_query(name, spark, sf_dir, duck):
    df = entry.queries()[name](spark, sf_dir)
    sql = entry.oracle_sql().get(name)
    if sql is None:
        assert df.count() > 0
    else:
        assert difference(df, duck, sql) is None


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
