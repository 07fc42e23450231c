"""Every named query against its SQL on the smallest data set."""

import pytest

import __spark_entry__ as entry_module
from check_oracles import compare, duck

SF = "/root/testdata/sf0.001"
QUERIES = entry_module.queries()
ORACLES = entry_module.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    ok, note = compare(spark, con, SF, name, QUERIES[name], ORACLES.get(name))
    assert ok, note


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


def test_entry_runs(spark):
    assert entry_module.entry(spark).count() == 25
