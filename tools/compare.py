"""Compare a Spark DataFrame with a DuckDB query result (order-insensitive).

Values are normalised the same way on both sides (decimals and floats to a
rounded float, dates to ISO text) and the row multisets are compared.
"""

from __future__ import annotations

import datetime as dt
import decimal
from collections import Counter

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    return con


EXACT = False


def _norm(v):
    if v is None:
        return None
    if isinstance(v, (float, decimal.Decimal)):
        return float(v) + 0.0 if EXACT else round(float(v), 6) + 0.0
    if isinstance(v, dt.datetime):
        return v.isoformat(sep=" ")
    if isinstance(v, dt.date):
        return v.isoformat()
    return v


def rows_of_spark(df):
    cols = sorted(df.columns)
    return cols, [tuple(_norm(r[c]) for c in cols) for r in df.collect()]


def rows_of_duck(con, sql):
    rel = con.sql(sql)
    names = rel.columns
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], [tuple(_norm(r[i]) for i in order) for r in rel.fetchall()]


def compare(df, con, sql) -> dict:
    sc, srows = rows_of_spark(df)
    dc, drows = rows_of_duck(con, sql)
    out = {"spark_rows": len(srows), "oracle_rows": len(drows),
           "columns_match": sc == dc}
    if sc != dc:
        out["spark_cols"], out["oracle_cols"] = sc, dc
    a, b = Counter(srows), Counter(drows)
    out["values_match"] = a == b
    if a != b:
        out["only_spark"] = list((a - b).elements())[:3]
        out["only_oracle"] = list((b - a).elements())[:3]
    return out
