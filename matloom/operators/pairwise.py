"""Gram matrices, correlations and distances of columns: n x n results of matrices with many rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ..matrix import BigMatrix, block
from .stats import column_stats, tree_sum


def gram(m: BigMatrix, centre: np.ndarray | None = None, centre_rows: bool = False) -> np.ndarray:
    """Sum over rows of the outer products of (row - centre); with centre_rows of rows less their own mean."""

    def partial(batches: Iterator[pa.RecordBatch]) -> np.ndarray | None:
        total = None
        for b in batches:
            x = block(b.column(0))
            if x.size:
                x = x - x.mean(1, keepdims=True) if centre_rows else x if centre is None else x - centre
                total = x.T @ x if total is None else total + x.T @ x
        return total

    got = tree_sum(m.df.select("v"), partial)
    return np.zeros((m.n_cols, m.n_cols)) if got is None else got


def _means(m: BigMatrix) -> tuple[np.ndarray, int]:
    """Column means and the number of rows, from one scan."""
    rows = {r["col"]: r for r in column_stats(m).collect()}
    return np.array([rows[j]["sum"] / rows[j]["cnt"] if j in rows else np.nan for j in range(m.n_cols)]), max((r["cnt"] for r in rows.values()), default=0)


def column_means(m: BigMatrix) -> np.ndarray:
    return _means(m)[0]


def covariance_sums(m: BigMatrix) -> np.ndarray:
    """Centred cross products, in two passes: means first."""
    return gram(m, column_means(m))


def pearson(m: BigMatrix) -> np.ndarray:
    c = covariance_sums(m)
    d = np.sqrt(np.diag(c))
    with np.errstate(invalid="ignore", divide="ignore"):
        return c / d[:, None] / d[None]


def euclidean(m: BigMatrix, squared: bool = False) -> np.ndarray:
    """Distances of columns, from two scans; columns are centred first, which changes no distance and saves digits."""
    mean, n = _means(m)
    c = gram(m, mean)
    s = np.diag(c)[:, None] + np.diag(c)[None] - 2 * c + n * (mean[:, None] - mean[None]) ** 2
    s = np.maximum(s, 0)
    return s if squared else np.sqrt(s)


def distance_matrix(m: BigMatrix, kind: str) -> np.ndarray:
    if kind == "correlation":
        return pearson(m)
    if kind == "euclidean":
        return euclidean(m)
    raise ValueError(f"unknown distance {kind}")


def pairs(spark: SparkSession, square: np.ndarray, name: str, diagonal: bool = False) -> DataFrame:
    """(a, b, name) of the upper triangle."""
    a, b = np.triu_indices(len(square), 0 if diagonal else 1)
    return spark.createDataFrame([(int(i), int(j), float(square[i, j])) for i, j in zip(a, b)], f"a int, b int, {name} double")
