"""Compares a registered query with its SQL on DuckDB."""

import glob
import math
import os

import duckdb

SMALL = "/root/testdata/sf0.001"


def _plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}")
    if isinstance(v, int) and not isinstance(v, bool):
        return float(f"{float(v):.9g}") if abs(v) < 2**53 else v
    if isinstance(v, list | tuple):
        return tuple(_plain(x) for x in v)
    return tuple(_plain(x) for x in v.values()) if isinstance(v, dict) else v


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(str(tuple(_plain(r[i]) for i in order)) for r in rows)


def assert_matches(spark, query, sql, sf_dir=SMALL):
    df = query(spark, sf_dir)
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for p in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"create view {os.path.basename(p)[:-8]} as select * from read_parquet('{p}')")
    want = con.execute(sql)
    names = [c[0] for c in want.description]
    assert sorted(names) == sorted(df.columns)
    assert rows_of(df.columns, df.collect()) == rows_of(names, want.fetchall())
