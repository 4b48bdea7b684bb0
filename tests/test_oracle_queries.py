"""Every registered query against its DuckDB oracle on the smallest tables."""

import pytest

import __spark_entry__ as entry
from inkwell.plans import QUERIES as PLANS
from tests.conftest import SMALL
from tests.oracle import compare, duck_connect

# The training-data queries have their own tests.
QUERIES = {n: entry.queries()[n] for n in PLANS}
ORACLE = {n: sql for n, sql in entry.oracle_sql().items() if n in PLANS}


@pytest.fixture(scope="module")
def duck():
    return duck_connect(SMALL)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_oracle(spark, duck, name):
    r = compare(spark, duck, name, QUERIES[name], ORACLE.get(name), SMALL)
    assert r["status"] in ("ok", "rows-only"), r


def test_entry_smoke(spark):
    df = entry.entry(spark)
    assert df.count() >= 0
    assert "article_id" in df.columns
