"""Runs queries against their SQL and compares rows, by column name, in any order."""

import math
import os

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def database(sf_dir):
    import duckdb

    c = duckdb.connect()
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        if os.path.exists(p):
            c.execute(f"CREATE VIEW {t} AS FROM read_parquet('{p + '/*.parquet' if os.path.isdir(p) else p}')")
    return c


def _plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if hasattr(v, "item"):
        v = v.item()
    return round(v, 9) + 0.0 if isinstance(v, float) else v


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_plain(r[i]) for i in order) for r in data), key=repr)


def compare(spark, c, name, f, sql, sf_dir):
    """None, or what differs."""
    df = f(spark, sf_dir)
    mine = rows(df.columns, [tuple(r) for r in df.collect()])
    got = c.execute(sql)
    columns = [x[0] for x in got.description]
    if sorted(columns) != sorted(df.columns):
        return f"columns {sorted(df.columns)} and {sorted(columns)}"
    theirs = rows(columns, got.fetchall())
    if mine != theirs:
        odd = [(a, b) for a, b in zip(mine, theirs, strict=False) if a != b][:3]
        return f"{len(mine)} and {len(theirs)} rows; {odd}"
    return None
