"""Every registered query equals its SQL oracle (DuckDB) on the sf0.001
tables: same columns, same multiset of rows."""

from __future__ import annotations

import pytest

from tests.conftest import SMALL

import __spark_entry__ as entry  # noqa: E402
from tools.compare import compare, duck  # noqa: E402

OTHER = entry._corpus_queries()
QUERIES = {k: f for k, f in entry.queries().items() if k not in OTHER}
ORACLE = {k: q for k, q in entry.oracle_sql().items() if k not in OTHER}


@pytest.fixture(scope="module")
def con():
    return duck(SMALL)


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLE)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_oracle(spark, con, name):
    r = compare(QUERIES[name](spark, SMALL), con, ORACLE[name])
    assert r["columns_match"], r
    assert r["values_match"], r


def test_entry_smoke(spark):
    df = entry.entry(spark)
    assert df.columns == ["zone", "currency", "type", "source", "amount_unit",
                          "equivalent_mmk", "equivalent_usd"]
    assert df.count() > 0
