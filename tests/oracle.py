"""Compares queries with their SQL: names, row counts and values."""

import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    return c


def norm(v):
    if isinstance(v, float):
        return f"{v:.9g}"
    return "~" if v is None else str(v)


def differences(df, con, sql):
    got = df.collect()
    cur = con.execute(sql)
    names = [x[0] for x in cur.description]
    want = cur.fetchall()
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} / {sorted(names)}"
    order = sorted(names)
    a = sorted(tuple(norm(r[c]) for c in order) for r in got)
    at = [names.index(c) for c in order]
    b = sorted(tuple(norm(r[i]) for i in at) for r in want)
    if a != b:
        return f"{len(a)} / {len(b)} rows; first differing: {next(((x, y) for x, y in zip(a, b) if x != y), 'none')}"
    return ""
