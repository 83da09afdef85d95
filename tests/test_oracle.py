"""Every core query with SQL agrees with it on the smallest tables; every other one runs."""

import pytest
from oracle import DATA, compare, connect

from citeloom import plans


@pytest.fixture(scope="module")
def con():
    return connect()


@pytest.mark.parametrize("name", sorted(plans.SQL))
def test_against_sql(spark, con, name):
    compare(spark, con, plans.QUERIES[name], plans.SQL[name])


@pytest.mark.parametrize("name", sorted(set(plans.QUERIES) - set(plans.SQL)))
def test_runs(spark, name):
    df = plans.QUERIES[name](spark, DATA)
    assert df.count() > 0


def test_every_sql_has_a_query():
    assert set(plans.SQL) <= set(plans.QUERIES)
