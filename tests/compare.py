"""Spark rows against DuckDB rows, in no particular order."""

import os

import duckdb
import numpy as np
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def value(v):
    if v is None or v is pd.NA or v is pd.NaT or (isinstance(v, float) and v != v):
        return "null"
    if isinstance(v, (list, np.ndarray)):
        return str([value(x) for x in v])
    if isinstance(v, (bool, np.bool_)):
        return str(bool(v))
    if isinstance(v, (float, np.floating, int, np.integer)) or type(v).__name__ == "Decimal":
        return f"{float(v):.6f}"
    return str(v)


def rows(df: pd.DataFrame) -> list[tuple]:
    names = sorted(df.columns)
    return sorted(tuple(value(v) for v in r) for r in df[names].itertuples(index=False))


def duck(sf_dir: str, sql: str) -> pd.DataFrame:
    con = duckdb.connect()
    for t in TABLES:
        if os.path.exists(p := f"{sf_dir}/{t}.parquet"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{p}'")
    return con.sql(sql).df()
