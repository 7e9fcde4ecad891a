"""Compare a query's rows with those of its oracle SQL in DuckDB."""

from __future__ import annotations

import datetime
import os

import duckdb
import numpy as np
import pandas as pd


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in os.listdir(folder):
        con.sql(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{folder}/{name}'")
    return con


def plain(v) -> str:
    if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, (float, np.floating)) and v != v):
        return "null"
    if isinstance(v, (bool, np.bool_)):
        return str(bool(v))
    if isinstance(v, (float, np.floating)):
        return str(int(v)) if float(v).is_integer() else repr(round(float(v), 6))
    if isinstance(v, (int, np.integer)):
        return str(int(v))
    if isinstance(v, (pd.Timestamp, datetime.datetime, datetime.date)):
        return str(pd.Timestamp(v))
    return str(v)


def rows(df: pd.DataFrame) -> list[tuple[str, ...]]:
    return sorted(tuple(plain(v) for v in r) for r in df[sorted(df.columns)].itertuples(index=False))
