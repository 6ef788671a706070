"""Every registered query against its DuckDB oracle on the smallest tables
(the driver runs the same comparison at sf0.01)."""

import pytest

import __spark_entry__ as E
from conftest import SMALL
from oracle_check import compare, duck

NAMES = sorted(E.queries())


@pytest.fixture(scope="module")
def con():
    return duck(SMALL)


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, con, name):
    r = compare(spark, con, name, E.queries()[name], E.oracle_sql().get(name), SMALL)
    assert r["ok"] in (True, None), r


def test_entry_runs(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) > 0 and set(df.columns) == {"dataset", "split", "total_tokens", "examples", "avg_tokens"}
