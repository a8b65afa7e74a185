"""Runs a query and its SQL side by side."""

import duckdb
import numpy as np
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connection(folder: str) -> duckdb.DuckDBPyConnection:
    c = duckdb.connect()
    c.sql("set timezone = 'UTC'")
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{folder}/{t}.parquet'")
    return c


def _text(x) -> str:
    if isinstance(x, list | np.ndarray):
        return "[" + ",".join(map(_text, x)) + "]"
    if x is None or x is pd.NaT or x is pd.NA or isinstance(x, float | np.floating) and np.isnan(x):
        return "~"
    if isinstance(x, bool | np.bool_):
        return str(bool(x))
    if isinstance(x, float | np.floating | int | np.integer):
        return str(int(x)) if x == int(x) else repr(round(float(x), 9))
    return str(x)


def rows(df: pd.DataFrame) -> list[str]:
    return sorted("|".join(map(_text, r)) for r in df[sorted(df.columns)].itertuples(index=False, name=None))
