"""Each query against independent SQL."""

import pytest

import __spark_entry__
from recordforge.queries.catalog import QUERIES, SQL
from tests.oracle import assert_same, connect


@pytest.fixture(scope="module")
def con(sf001):
    return connect(sf001)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf001, con, name):
    df = QUERIES[name](spark, sf001)
    if name in SQL:
        assert_same(df, con, SQL[name])
    else:
        assert df.count() >= 0 and len(set(df.columns)) == len(df.columns)


def test_entry_has_a_stable_schema(spark):
    a, b = __spark_entry__.entry(spark), __spark_entry__.entry(spark)
    assert a.schema == b.schema and a.count() == 1


def test_sql_is_of_known_queries():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
