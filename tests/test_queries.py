import pytest

from graphloom.plans.oracle import SQL
from graphloom.plans.queries import QUERIES
from tests.compare import same


@pytest.mark.parametrize("name", sorted(SQL))
def test_against_sql(spark, name):
    same(spark, name, "/root/testdata/sf0.01", QUERIES, SQL)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, name):
    assert QUERIES[name](spark, "/root/testdata/sf0.001").count() > 0
