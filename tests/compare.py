"""Holds a Spark result against DuckDB's over the same Parquet tables."""

from __future__ import annotations

import math
import os

import duckdb
import pandas as pd

DATA = os.environ.get("FRAMEWRIGHT_TESTDATA", "/root/testdata")


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for f in sorted(os.listdir(sf_dir)):
        path = os.path.join(sf_dir, f)
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{path}{'/*.parquet' if os.path.isdir(path) else ''}')")
    return con


def cell(x: object) -> object:
    if x is None or x is pd.NaT or (isinstance(x, float) and math.isnan(x)) or x is pd.NA:
        return None
    if hasattr(x, "tolist"):
        x = x.tolist()
    if isinstance(x, bool):
        return x
    if isinstance(x, (int, float)):
        return round(float(x), 6) + 0.0
    if isinstance(x, (list, tuple)):
        return tuple(map(cell, x))
    return x


def rows(frame: pd.DataFrame) -> list[tuple]:
    columns = sorted(frame.columns)
    return sorted((tuple(map(cell, r)) for r in frame[columns].astype(object).itertuples(index=False, name=None)), key=repr)


def difference(spark_df, sql: str, con: duckdb.DuckDBPyConnection) -> str:
    """'' if equal, else what differs."""
    a, b = spark_df.toPandas(), con.execute(sql).df()
    if sorted(a.columns) != sorted(b.columns):
        return f"columns {sorted(a.columns)} and {sorted(b.columns)}"
    x, y = rows(a), rows(b)
    if len(x) != len(y):
        return f"{len(x)} and {len(y)} rows"
    wrong = [(p, q) for p, q in zip(x, y) if p != q]
    return f"{len(wrong)} of {len(x)} rows, as {wrong[0]}" if wrong else ""
