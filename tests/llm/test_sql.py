"""Queries against their DuckDB SQL, on whole tables."""

from __future__ import annotations

import duckdb
import pytest

from tallyspark.llm import license_scan
from tallyspark.llm.queries import ORACLE_SQL, QUERIES
from tools.compare import compare, duck

from .helpers import corpus, documents

SF = "/root/testdata/sf0.01"


def test_every_query_is_registered():
    assert sorted(int(k[2:].split("_")[0]) for k in QUERIES) == list(range(1, 14))
    assert set(ORACLE_SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, name):
    got = compare(QUERIES[name](spark, SF), duck(SF), ORACLE_SQL[name])
    assert got["columns_match"] and got["values_match"], got


def test_license_sql_on_whole_license_texts(spark, tmp_path):
    """The given tables hold no whole license."""
    texts = [t.split() for t in license_scan.TEXTS]
    rows = corpus(n=20) + [(1000 + k, " ".join(t)) for k, t in enumerate(texts)]
    for step in (3, 11, 29, 47):  # words left out and put in, and other words around
        rows += [(1000 * step + k, "some code. " * k + " ".join(w for i, w in enumerate(t) if i % step != 1)
                  + "\nq " + " ".join(w + " new" * (i % step == 2) for i, w in enumerate(t)))
                 for k, t in enumerate(texts)]
    seen = set()
    rows = [r for r in rows if r[0] is not None and not (r[0] in seen or seen.add(r[0]))]
    documents(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"create view documents as select * from read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    name = "op4_license_scan"
    got = compare(QUERIES[name](spark, str(tmp_path)), con, ORACLE_SQL[name])
    assert got["columns_match"] and got["values_match"], got
