"""Comparing a Spark result with DuckDB's: same columns, same rows in any order, numbers to six places."""

from __future__ import annotations

import numbers
import os
from collections import Counter
from glob import glob

import duckdb
import pandas as pd


def connect(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob(f"{sf}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{path}{'/*.parquet' if os.path.isdir(path) else ''}')")
    return con


def _cell(v: object) -> object:
    if v is None or v is pd.NaT or v is pd.NA:
        return None
    if isinstance(v, numbers.Number) and not isinstance(v, bool):
        return round(float(v), 6) if v == v else None
    if isinstance(v, str):
        return v
    return str(v) if not hasattr(v, "__iter__") else tuple(map(_cell, v))


def rows(df: pd.DataFrame) -> Counter:
    df = df[sorted(df.columns)]
    return Counter(tuple(map(_cell, r)) for r in df.astype(object).itertuples(index=False, name=None))


def assert_same(got: pd.DataFrame, want: pd.DataFrame) -> None:
    assert sorted(got.columns) == sorted(want.columns)
    a, b = rows(got), rows(want)
    assert a == b, f"only here: {list((a - b).elements())[:3]}, only in SQL: {list((b - a).elements())[:3]}"
