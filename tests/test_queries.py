import __spark_entry__
import oracle
import pytest

from weftgraph import plans

SF = "/root/testdata/sf0.001"
SLOW = {"louvain"}  # covered by tests of their operators


@pytest.fixture(scope="module")
def con():
    return oracle.connect(SF)


@pytest.mark.parametrize("name", sorted(plans.SQL))
def test_query_equals_its_sql(spark, con, name):
    assert oracle.compare(plans.QUERIES[name](spark, SF), con, plans.SQL[name]) == ""


@pytest.mark.parametrize("name", sorted(set(plans.QUERIES) - set(plans.SQL) - SLOW))
def test_query_without_sql_runs(spark, name):
    assert plans.QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() == 10
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
