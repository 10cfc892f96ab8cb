"""Every query with SQL agrees with it; every other one runs and has rows."""

import pytest

import __spark_entry__ as entry
from lexmill.plans import catalog


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_agrees_with_sql(name, agree):
    agree(catalog.QUERIES[name], catalog.ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_query_runs(name, spark, data):
    """Rows without nulls in their keys, each once, and the same on a second run."""
    first, second = ([tuple(map(str, r)) for r in catalog.QUERIES[name](spark, data).collect()] for _ in range(2))
    assert first and sorted(first) == sorted(second) and len(set(first)) == len(first)
    assert all(r[0] != "None" for r in first)


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
