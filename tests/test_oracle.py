"""Every registered query against DuckDB on the given tables."""

import pytest

import __spark_entry__ as contract
import oracle
from daybook.oracles import ORACLES
from daybook.queries import QUERIES

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return oracle.connect(SF_DIR)


def test_every_query_has_sql():
    assert QUERIES.keys() == ORACLES.keys()
    assert contract.oracle_sql().keys() <= contract.queries().keys()


@pytest.mark.parametrize("name", contract.oracle_sql())
def test_query(spark, duck, name):
    result = contract.queries()[name](spark, SF_DIR)
    assert oracle.differences(result, duck, contract.oracle_sql()[name]) == []


def test_entry(spark):
    assert contract.entry(spark).count() == 1311
