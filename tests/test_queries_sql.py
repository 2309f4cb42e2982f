import pytest

from leadflow import queries
from oracle import assert_same, connection


@pytest.fixture(scope="module")
def con(root):
    return connection(root)


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_agrees_with_sql(spark, con, root, name):
    assert_same(spark, con, root, queries.QUERIES[name], queries.SQL[name])


def test_every_query_without_sql_has_rows(spark, root):
    for name in set(queries.QUERIES) - set(queries.SQL):
        assert queries.QUERIES[name](spark, root).count() > 0
