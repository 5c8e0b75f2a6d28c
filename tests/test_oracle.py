"""Every registered query against its SQL on the smallest scale."""

import pytest

import __spark_entry__ as entry
from tests import harness

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return harness.connect(FOLDER)


OWN = [name for name in entry.queries() if not name.startswith("op") and name != "pipeline"]


def test_every_query_has_sql():
    assert set(OWN) <= set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).columns == ["lang", "type", "findings", "left_over"]


@pytest.mark.parametrize("name", OWN)
def test_query(spark, con, name):
    result = harness.compare(spark, con, name, FOLDER)
    assert result == ""
