"""Row-by-row comparison of a Spark result with a DuckDB one."""

from __future__ import annotations

import os

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    c = duckdb.connect()
    c.execute("set timezone = 'UTC'")
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        c.execute(f"create view {t} as select * from '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return c


def plain(v):
    if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and v != v):
        return None
    if hasattr(v, "item"):
        v = v.item()
    return str(v) if isinstance(v, bool) else repr(float(v)) if isinstance(v, (int, float)) else str(v)


def rows(df: pd.DataFrame) -> list[tuple]:
    df = df[sorted(df.columns)].astype(object)
    return sorted((tuple(plain(v) for v in r) for r in df.values.tolist()), key=str)


def assert_same(ours: pd.DataFrame, theirs: pd.DataFrame) -> None:
    assert sorted(ours.columns) == sorted(theirs.columns)
    a, b = rows(ours), rows(theirs)
    assert len(a) == len(b)
    assert a == b
