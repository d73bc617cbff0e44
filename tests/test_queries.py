"""Every registered query against its SQL twin on the smallest tables."""

import pytest
from oracle import compare

import __spark_entry__ as entry
from kilnset.plans import catalog

# queries of the training-data subpackage have their own tests
RUNS = {name: run for name, run in entry.queries().items() if name in catalog.QUERIES}
SQL = {name: sql for name, sql in entry.oracle_sql().items() if name in catalog.QUERIES}


@pytest.mark.parametrize("name", list(RUNS))
def test_query(spark, name):
    res = compare(spark, RUNS[name], SQL.get(name), "/root/testdata/sf0.001")
    assert res["status"] in ("ok", "rows"), res["note"]
    assert res["rows"] > 0


def test_flagship(spark):
    assert entry.entry(spark).count() > 0


def test_sql_names_are_queries():
    assert set(SQL) <= set(RUNS)
