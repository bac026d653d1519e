"""Compare a query with its SQL, both over the same tables."""

from __future__ import annotations

import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        p = f"{p}/*.parquet" if os.path.isdir(p) else p
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


def canon(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}")
    if isinstance(v, (list, tuple)):
        return tuple(canon(x) for x in v)
    return v


def compare(spark, query, sql: str, sf_dir: str) -> int:
    """Assert equal columns and rows; the number of rows."""
    df = query(spark, sf_dir)
    got_cols = sorted(df.columns)
    got = sorted((tuple(canon(r[c]) for c in got_cols) for r in df.collect()), key=repr)
    rel = connect(sf_dir).sql(sql)
    assert sorted(rel.columns) == got_cols, (rel.columns, df.columns)
    at = [rel.columns.index(c) for c in got_cols]
    want = sorted((tuple(canon(r[i]) for i in at) for r in rel.fetchall()), key=repr)
    assert len(got) == len(want), (len(got), len(want))
    for a, b in zip(got, want, strict=True):
        assert a == b, (got_cols, a, b)
    return len(got)
