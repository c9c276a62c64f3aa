"""Every registered query against its SQL on the small tables."""

from __future__ import annotations

import pytest
from check import compare

from tonelake.plans.catalog import load

QUERIES = load()
WITH_SQL = [n for n, q in QUERIES.items() if q.sql is not None]
WITHOUT_SQL = [n for n, q in QUERIES.items() if q.sql is None]


@pytest.mark.parametrize("name", WITH_SQL)
def test_matches_sql(spark, duck, sf_dir, name):
    got = QUERIES[name](spark, sf_dir).toPandas()
    want = duck.execute(QUERIES[name].sql).df()
    assert compare(got, want) == ""


@pytest.mark.parametrize("name", WITHOUT_SQL)
def test_runs(spark, sf_dir, name):
    assert len(QUERIES[name](spark, sf_dir).toPandas()) > 0


def test_entry_contract(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() == 5
