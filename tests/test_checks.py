"""Every query against its SQL over the whole small folder."""

import pytest

import __spark_entry__ as entry
from docket.catalog import QUERIES
from oracles.compare import connect, difference

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


def test_every_query_is_checked():
    assert set(QUERIES) <= set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).columns[:3] == ["report_id", "pos", "doc_id"]


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    assert difference(spark, con, entry.queries()[name], entry.oracle_sql()[name], SF) == ""
