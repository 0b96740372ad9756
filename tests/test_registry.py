"""Every registered query against its SQL on the smallest tables, and the entry points."""

import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))
from compare import compare, duck  # noqa: E402

import __spark_entry__ as contract  # noqa: E402
from riskloom.registry import all_oracles, all_queries  # noqa: E402

QUERIES, ORACLES = all_queries(), all_oracles()


@pytest.fixture(scope="module")
def con(folder):
    return duck(folder)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, con, folder, name):
    assert compare(spark, con, QUERIES[name], ORACLES[name], folder) == ""


def test_every_query_has_its_sql():
    assert set(QUERIES) == set(ORACLES)


def test_the_contract_offers_every_query():
    assert set(QUERIES) <= set(contract.queries()) and set(ORACLES) <= set(contract.oracle_sql())
    assert set(contract.oracle_sql()) <= set(contract.queries())


def test_entry(spark):
    assert contract.entry(spark).count() > 0
