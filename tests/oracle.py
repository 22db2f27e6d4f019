"""Run a registered query and its SQL on the same tables and compare the rows."""

import glob
import math
import os

import duckdb


def tables(sf):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for path in glob.glob(f"{sf}/*.parquet"):
        name = os.path.basename(path)[:-8]
        source = f"{path}/*.parquet" if os.path.isdir(path) else path
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{source}'")
    return con


def norm(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, float):
        return round(v, 6)
    return v


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(norm(r[i]) for i in order) for r in data), key=repr)


def compare(spark, con, sf, name, fn, sql):
    df = fn(spark, sf)
    got = df.collect()
    cur = con.execute(sql)
    columns = [x[0] for x in cur.description]
    want = cur.fetchall()
    assert sorted(df.columns) == sorted(columns), (name, df.columns, columns)
    assert rows(df.columns, got) == rows(columns, want), (name, len(got), len(want), rows(df.columns, got)[:2], rows(columns, want)[:2])
    return len(got)
