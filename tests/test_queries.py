"""Every registered query on the smallest data, next to its SQL where it has one."""

import pytest
from compare import DATA, compare, connect

import __spark_entry__ as entry

SF = f"{DATA}/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


def test_contract(spark):
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query(spark, con, name):
    state, got, want = compare(spark, con, SF, name)
    assert state in ("ok", "rows-only"), (state, got, want)
