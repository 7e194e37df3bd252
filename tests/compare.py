"""Rows of a query and of its SQL in DuckDB, in a form that can be compared."""

import datetime as dt
import glob
import os

import duckdb


def plain(v):
    if isinstance(v, float):
        return None if v != v else int(v) if v == int(v) and abs(v) < 1e15 else round(v, 6)
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None).isoformat()
    return v


def spark_rows(df):
    names = sorted(df.columns)
    return names, sorted(repr(tuple(plain(r[n]) for n in names)) for r in df.collect())


def duck_rows(sql, sf_dir):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(path).split('.')[0]} AS SELECT * FROM '{path}'")
    rel = con.sql(sql)
    names = sorted(rel.columns)
    at = [rel.columns.index(n) for n in names]
    return names, sorted(repr(tuple(plain(r[i]) for i in at)) for r in rel.fetchall())
