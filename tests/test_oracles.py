"""Every registered query against its oracle SQL on the smallest data set."""

import re

import pytest

import __spark_entry__ as entry
from compare import connect, difference

SF = "/root/testdata/sf0.001"
ROWS_ONLY = {"isolation_forest", "ml_alerts"}
OWN = sorted(q for q in entry.queries() if q != "pipeline" and not re.match(r"op\d+_", q))


@pytest.fixture(scope="module")
def con():
    return connect(SF)


def test_registry():
    assert set(OWN) - set(entry.oracle_sql()) == ROWS_ONLY
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", OWN)
def test_query(spark, con, name):
    df = entry.queries()[name](spark, SF)
    if name in ROWS_ONLY:
        assert df.count() >= 0
    else:
        assert difference(df, con, entry.oracle_sql()[name]) is None


def test_entry(spark):
    rows = entry.entry(spark).collect()
    assert rows and sum(r.event_count for r in rows) > 0
