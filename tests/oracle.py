"""Compares a query's rows with those of its SQL in DuckDB."""

import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if v != v else f"{v:.9g}"
    if isinstance(v, dict):
        v = list(v.values())
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(map(plain, v)) + "]"
    return str(v)


def compare(df, con, sql):
    names = sorted(df.columns)
    found = con.execute(sql)
    there = [d[0] for d in found.description]
    assert sorted(there) == names
    want = sorted("|".join(plain(r[there.index(c)]) for c in names) for r in found.fetchall())
    got = sorted("|".join(plain(r[c]) for c in names) for r in df.collect())
    assert got == want
    return len(got)
