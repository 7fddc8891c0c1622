"""Every registered array, matching, series and stream query against its SQL; those without SQL must run."""

import pytest

import gridloom.plans  # noqa: F401
from compare import engine, rows
from gridloom.plans.registry import ORACLES, QUERIES

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return engine(DIR)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, con, name):
    got = QUERIES[name](spark, DIR).toPandas()
    assert rows(got) == rows(con.execute(ORACLES[name]).df())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, name):
    assert QUERIES[name](spark, DIR).count() > 0
