"""Every registered query against its SQL twin on the smallest tables."""

from __future__ import annotations

import pytest

import __spark_entry__ as contract
from shelfcast.plans import catalog, oracle
from comparing import connect, differences


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


def test_every_query_has_sql():
    assert set(catalog.queries()) == set(oracle.statements())
    assert set(catalog.queries()) <= set(contract.queries())


@pytest.mark.parametrize("name", list(catalog.queries()))
def test_same_result(spark, sf_dir, con, name):
    assert differences(catalog.queries()[name](spark, sf_dir), con, oracle.statements()[name]) == []


def test_entry(spark):
    assert contract.entry(spark).count() > 0
