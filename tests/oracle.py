"""Compares a Spark result with DuckDB's on the same tables."""

from pathlib import Path

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        if Path(folder, f"{t}.parquet").exists():
            con.sql(f"create view {t} as select * from '{folder}/{t}.parquet'")
    return con


def _normal(df: pd.DataFrame) -> pd.DataFrame:
    out = df[sorted(df.columns)].copy()
    for c in out.columns:
        number = pd.api.types.is_numeric_dtype(out[c]) and not pd.api.types.is_bool_dtype(out[c])
        out[c] = (out[c].astype(float).round(5) + 0.0).map(str) if number else out[c].map(str)
    return out.sort_values(list(out.columns)).reset_index(drop=True)


def assert_same(got: pd.DataFrame, expected: pd.DataFrame) -> None:
    assert sorted(got.columns) == sorted(expected.columns)
    assert len(got) == len(expected)
    pd.testing.assert_frame_equal(_normal(got), _normal(expected))
