"""Rows of a query and of its SQL on the same tables, without order."""

import glob
import math
import os

import duckdb
import pandas as pd


def connect(folder: str):
    con = duckdb.connect()
    for path in glob.glob(f"{folder}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def _plain(v):
    if v is None or v is pd.NA or v is pd.NaT:
        return None
    if hasattr(v, "item"):
        v = v.item()
    if isinstance(v, float):
        return None if math.isnan(v) else int(v) if v == int(v) and abs(v) < 1e15 else v
    return v


def rows(frame: pd.DataFrame) -> list:
    columns = sorted(frame.columns)
    return sorted((tuple(map(_plain, r)) for r in frame[columns].itertuples(index=False)), key=repr)


def assert_same(query, sql: str, spark, folder: str) -> None:
    got, want = query(spark, folder).toPandas(), connect(folder).sql(sql).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)
