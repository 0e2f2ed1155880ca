"""Every registered query against its SQL, on the smallest test tables."""

import pytest
from compare import compare, connect

import __spark_entry__ as entry

SF_DIR = "/root/testdata/sf0.001"
QUERIES, SQL = entry.queries(), entry.oracle_sql()

# Stretches of failures that the smallest tables may not hold.
RARE = {"outage_sessions", "outage_windows", "stream_outage_windows"}


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_matches_sql(spark, con, name):
    rows, _, problem = compare(QUERIES[name](spark, SF_DIR), con, SQL.get(name))
    assert problem is None
    assert rows > 0 or name in RARE


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_sync_invariant(spark):
    for row in entry.queries()["sync_summary"](spark, SF_DIR).collect():
        assert row.processed == row.created + row.updated + row.skipped
