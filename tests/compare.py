"""Runs a query and its SQL side by side and compares all rows."""

import os

import duckdb
import numpy as np
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def views(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    return con


def plain(v):
    if isinstance(v, (list, tuple, np.ndarray)):
        return str([plain(x) for x in v])
    if v is None or v is pd.NaT or (isinstance(v, float) and np.isnan(v)) or v is pd.NA:
        return "null"
    if hasattr(v, "item"):
        return plain(v.item())
    if isinstance(v, float):
        return str(int(v)) if v == int(v) else f"{v:.9g}"
    return str(v)


def rows(frame):
    columns = sorted(frame.columns)
    return columns, sorted(map(tuple, frame[columns].map(plain).values.tolist()))


def assert_same(spark_df, sql, con):
    got, want = rows(spark_df.toPandas()), rows(con.sql(sql).df())
    assert got[0] == want[0]
    assert len(got[1]) == len(want[1])
    assert got[1] == want[1]
