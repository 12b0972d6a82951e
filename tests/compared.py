"""Rows of a query and of its SQL, made comparable: columns by name, rows sorted, numbers to nine digits."""

from __future__ import annotations

import os

import pandas as pd

FOLDER = "/root/testdata/sf0.001"


def connected():
    import duckdb

    con = duckdb.connect()
    for f in sorted(os.listdir(FOLDER)):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{FOLDER}/{f}')")
    return con


def _plain(x):
    if hasattr(x, "tolist"):
        x = x.tolist()
    if isinstance(x, (list, tuple)):
        return [_plain(y) for y in x]
    if isinstance(x, dict):
        return {k: _plain(v) for k, v in x.items()}
    if x is None or x is pd.NA or x is pd.NaT or isinstance(x, float) and x != x:
        return None
    if isinstance(x, (int, float)) and not isinstance(x, bool):
        return float(f"{x:.9g}")
    return x


def rows_of(frame: pd.DataFrame) -> list[str]:
    frame = frame[sorted(frame.columns)]
    return sorted(str([_plain(x) for x in row]) for row in frame.itertuples(index=False, name=None))
