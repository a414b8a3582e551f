"""Spark results against DuckDB's, rows in any order."""

import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def normal(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    return v


def duck(folder):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        path = f"{folder}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


def same(df, con, sql):
    """Raises AssertionError unless columns and rows agree."""
    names = sorted(df.columns)
    got = sorted((tuple(normal(r[c]) for c in names) for r in df.collect()), key=repr)
    cur = con.execute(sql)
    cols = [c[0] for c in cur.description]
    assert sorted(cols) == names, (sorted(cols), names)
    at = [cols.index(c) for c in names]
    want = sorted((tuple(normal(r[i]) for i in at) for r in cur.fetchall()), key=repr)
    assert len(got) == len(want), (len(got), len(want))
    for a, b in zip(got, want, strict=True):
        assert a == b, (a, b)
    return len(got)
