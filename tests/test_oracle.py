"""Every registered query against its DuckDB oracle (sf0.001), as the round driver does."""

import pytest

import __spark_entry__ as E
from tools.oracle_check import compare, duck

QUERIES = E.queries()
ORACLE = E.oracle_sql()


@pytest.fixture(scope="module")
def con(sf_dir):
    return duck(sf_dir)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_oracle(spark, con, sf_dir, name):
    r = compare(spark, con, name, QUERIES[name], ORACLE.get(name), sf_dir)
    assert r["status"] in ("match", "rows-only"), r


def test_entry_runs(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) > 0
    assert df.columns == ["table_name", "column_name", "metric_name", "value"]


def test_every_oracle_has_a_query():
    assert set(ORACLE) <= set(QUERIES)
