"""Every registered query against its oracle on the smallest tables, and its plan."""

import pytest

import check
from test_plans import check_plan

from oracle.queries import ORACLES
from slipstream.plans.catalog import QUERIES, run_query

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def oracle():
    return check.oracle_connection(SF_DIR)


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_oracle(spark, oracle, name):
    df = run_query(name, spark, SF_DIR)
    check_plan(name, df)
    assert check.difference(df.toPandas(), oracle.execute(ORACLES[name]).df()) is None
