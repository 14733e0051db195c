"""Query results against DuckDB."""

import glob
import math
import os

import duckdb
import numpy as np
import pandas as pd


def plain(v):
    if v is None or v is pd.NA or isinstance(v, (float, np.floating)) and math.isnan(v):
        return None
    if isinstance(v, (bool, np.bool_)):
        return bool(v)
    if isinstance(v, (float, np.floating)):
        return round(float(v), 5) + 0.0
    return int(v) if hasattr(v, "__index__") else v


def rows(df: pd.DataFrame) -> list[tuple]:
    df = df[sorted(df.columns)]
    return sorted((tuple(map(plain, r)) for r in df.itertuples(index=False)), key=repr)


def oracle(sf_dir: str, sql: str) -> pd.DataFrame:
    con = duckdb.connect()
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con.sql(sql).df()


def same(got: pd.DataFrame, expected: pd.DataFrame) -> None:
    assert sorted(got.columns) == sorted(expected.columns)
    assert rows(got.astype({c: "float64" for c in got.columns if c == "refers_to"})) == rows(expected.astype({c: "float64" for c in expected.columns if c == "refers_to"}))
