"""Every registered query against its SQL counterpart, and the contract itself."""

import pytest

import __spark_entry__ as contract
from compare import connect, difference
from epispark import workloads

FOLDER = "/root/testdata/sf0.001"
QUERIES, ORACLES = workloads.queries(), workloads.oracle_sql()
ROWS_ONLY = {"weighted_classifier"}


@pytest.fixture(scope="module")
def duck():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, duck, name):
    assert difference(QUERIES[name](spark, FOLDER), duck, ORACLES[name]) is None


@pytest.mark.parametrize("name", sorted(ROWS_ONLY))
def test_rows_only(spark, name):
    assert QUERIES[name](spark, FOLDER).count() > 0


def test_every_query_has_sql_or_is_listed():
    assert set(QUERIES) - set(ORACLES) == ROWS_ONLY
    assert not set(ORACLES) - set(QUERIES)


def test_contract_has_every_query():
    assert set(QUERIES) <= set(contract.queries())
    assert set(ORACLES) <= set(contract.oracle_sql())


def test_entry(spark):
    assert contract.entry(spark).count() > 0
