"""Compares a query's rows with those of its SQL in DuckDB."""

import glob
import os

import duckdb
import numpy as np
import pandas as pd


def tables(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def _plain(x):
    if x is None or x is pd.NaT or (isinstance(x, float) and np.isnan(x)) or x is pd.NA:
        return "None"
    if isinstance(x, pd.Timestamp):
        return str(x).removesuffix(" 00:00:00")
    return str(x)


def rows(df: pd.DataFrame) -> tuple[list[str], list[tuple]]:
    names = sorted(df.columns)
    columns = []
    for c in names:
        values = df[c]
        if pd.api.types.is_bool_dtype(values):
            columns.append(values.map(_plain).tolist())
        elif pd.api.types.is_numeric_dtype(values):
            columns.append([f"{x:.9g}" if not np.isnan(x) else "None" for x in values.astype("float64").tolist()])
        else:
            columns.append(values.map(_plain).tolist())
    return names, sorted(zip(*columns, strict=True)) if columns else []
