"""Comparison of registered queries with their SQL in DuckDB."""

import math
from pathlib import Path

import duckdb

DATA = "/root/testdata/sf0.001"


def _plain(v):
    if v is None:
        return "null"
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.9g}"
    return str(v)


def differences(spark, query, sql, data=DATA):
    """Rows only the query has, and rows only the SQL has."""
    con = duckdb.connect()
    for p in Path(data).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    found = query(spark, data)
    expected = con.sql(sql)
    assert sorted(found.columns) == sorted(expected.columns)
    order = sorted(found.columns)
    a = sorted(tuple(_plain(r[c]) for c in order) for r in found.collect())
    at = [expected.columns.index(c) for c in order]
    b = sorted(tuple(_plain(r[i]) for i in at) for r in expected.fetchall())
    if a == b:
        return [], []
    sa, sb = set(a), set(b)
    return (sorted(sa - sb) or ["repeated rows"])[:5], (sorted(sb - sa) or ["repeated rows"])[:5]
