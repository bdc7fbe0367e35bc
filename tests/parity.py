"""Compares a query with its SQL: columns, rows, values in any order."""

import glob
import os

import duckdb
import pandas as pd


def cell(v):
    if hasattr(v, "__len__") and not isinstance(v, (str, bytes)):
        return str([str(x) for x in v])
    if v is None or v is pd.NA or v != v:
        return "null"
    if isinstance(v, (int, float)) and not isinstance(v, bool):
        return repr(round(float(v), 8))
    return str(v)


def rows(frame):
    names = sorted(frame.columns)
    return names, sorted("|".join(cell(v) for v in r) for r in frame[names].astype(object).values.tolist())


def check(spark, sf_dir, query, sql):
    db = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        db.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    assert rows(query(spark, sf_dir).toPandas()) == rows(db.sql(sql).df())
