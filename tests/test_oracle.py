"""Every registered query against its SQL at the smallest scale."""

from __future__ import annotations

from pathlib import Path

import pytest

import __spark_entry__ as entry
from check_oracle import connect, differences

SF_DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF_DIR).exists(), reason="test tables are absent")


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


#: Queries over the tables of the library itself; those for training text have tests of their own.
NAMES = sorted(n for n in entry.queries() if n != "pipeline" and not n.startswith("op"))


def test_every_query_has_its_sql():
    assert set(NAMES) <= set(entry.oracle_sql()) <= set(entry.queries())


def test_the_time_modes_differ_on_these_tables(con):
    sql = entry.oracle_sql()
    second, micro = (
        con.execute(f"SELECT count(*) FROM ({sql[n]})").fetchone()[0]
        for n in ("linked_time_window", "linked_time_window_micro")
    )
    assert second > micro


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, con, name):
    _, problem = differences(entry.queries()[name](spark, SF_DIR), con, entry.oracle_sql()[name])
    assert problem is None


def test_entry(spark):
    assert entry.entry(spark).count() == 36
