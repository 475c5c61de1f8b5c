"""Comparing a query with its SQL in DuckDB."""

import os
from collections import Counter

import duckdb

DATA = "/root/testdata/sf0.001"


def normal(v):
    if v is None:
        return None
    if isinstance(v, float):
        return None if v != v else float(f"{v:.5g}") if abs(v) > 1e-9 else 0.0
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, (list, tuple)):
        return tuple(normal(x) for x in v)
    if hasattr(v, "isoformat"):
        return v.replace(tzinfo=None).isoformat()
    return v


def both(spark, query, sql, data=DATA):
    """The rows of the query and of its SQL, as counters over equal columns."""
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for f in os.listdir(data):
        con.execute(f"CREATE VIEW {f[: -len('.parquet')]} AS SELECT * FROM '{data}/{f}'")
    df = query(spark, data)
    cols = sorted(df.columns)
    ours = Counter(tuple(normal(r[c]) for c in cols) for r in df.collect())
    got = con.execute(sql)
    names = [d[0] for d in got.description]
    assert sorted(names) == cols
    theirs = Counter(tuple(normal(r[names.index(c)]) for c in cols) for r in got.fetchall())
    return ours, theirs
