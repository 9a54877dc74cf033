"""Every registered query against its SQL."""

from __future__ import annotations

import os

import pytest

import __spark_entry__ as registered
from tests.oracle import connect, differences
from vecloom.plans.catalog import ENTRIES

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def connection():
    return connect(SF_DIR)


def test_every_query_has_sql():
    assert set(ENTRIES) <= set(registered.oracle_sql())


@pytest.mark.parametrize("name", sorted(ENTRIES))
def test_query(spark, connection, name):
    result = registered.queries()[name](spark, SF_DIR)
    assert differences(result, connection, registered.oracle_sql()[name]) == []


def test_entry(spark):
    result = registered.entry(spark)
    assert result.columns == ["label", "n", "loss"]
    assert result.count() == 10
