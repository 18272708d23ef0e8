"""Every registered query against its SQL, on the smallest tables."""

from __future__ import annotations

import pytest

import __spark_entry__ as contract
from verification.compare import connect, difference
from verification.oracle import all_sql
from verification.queries import all_queries


@pytest.fixture(scope="module")
def con(small):
    return connect(small)


def test_every_query_has_sql():
    assert set(all_queries()) == set(all_sql())
    assert set(all_queries()) <= set(contract.queries())
    assert set(contract.oracle_sql()) <= set(contract.queries())


@pytest.mark.parametrize("name", sorted(all_queries()))
def test_query_equals_sql(spark, con, small, name):
    assert difference(spark, con, small, name) == ""


def test_entry(spark):
    df = contract.entry(spark)
    assert df.columns[:4] == ["year", "buyer", "seller", "type"]
    assert df.count() > 0
