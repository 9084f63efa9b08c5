"""Row adjustment, scaling and logarithms. Whole rows go through numpy in Arrow batches: a lambda
over an array cannot hold a row's mean, and would work it out again for every cell."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..matrix import BigMatrix

EPS = float(np.finfo(float).eps)


def _centred(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    c = x - x.mean(1, keepdims=True)
    return c, (c * c).sum(1, keepdims=True)


def _scaled(x: np.ndarray, size: np.ndarray, flat: float, least: np.ndarray) -> np.ndarray:
    return np.where(least < EPS, flat, x / np.where(least < EPS, 1.0, size))


def unit_sd(x: np.ndarray) -> np.ndarray:
    """Mean 0 and population standard deviation 1; flat rows become 0."""
    c, ss = _centred(x)
    sd = np.sqrt(ss / x.shape[1])
    return _scaled(c, sd, 0.0, sd)


def unit_length(x: np.ndarray) -> np.ndarray:
    """Mean 0 and length 1; flat rows become 1 / sqrt(n)."""
    c, ss = _centred(x)
    return _scaled(c, np.sqrt(ss), x.shape[1] ** -0.5, np.sqrt(ss / x.shape[1]))


def unit_length_or_zero(x: np.ndarray) -> np.ndarray:
    c, ss = _centred(x)
    return _scaled(c, np.sqrt(ss), 0.0, np.sqrt(ss / x.shape[1]))


ADJUSTMENTS = {"zero_mean_unit_sd": unit_sd, "zero_mean_unit_length": unit_length, "zero_mean_unit_length_const0": unit_length_or_zero}


def adjust_rows(m: BigMatrix, how: str) -> BigMatrix:
    return m.map(ADJUSTMENTS[how])


def _column_sums(m: BigMatrix) -> np.ndarray:
    from .stats import column_stats

    sums = {r["col"]: r["sum"] for r in column_stats(m).collect()}  # a row per column
    return np.array([sums.get(j, 0.0) for j in range(m.n_cols)])


def divide_by_column_sum(m: BigMatrix, sums: np.ndarray | None = None) -> BigMatrix:
    """Cells times the reciprocal of their column's sum; a sum of zero is an error."""
    sums = _column_sums(m) if sums is None else np.asarray(sums, float)
    if (sums == 0).any() or np.isnan(sums).any():
        raise ValueError("a column sum is zero or missing")
    share = 1.0 / sums
    return m.map(lambda x: x * share)


def common_library_size(m: BigMatrix, size: float | str = 6e7) -> BigMatrix:
    """Columns scaled to one sum: a number, or "median" of the column sums."""
    sums = _column_sums(m)
    if (sums == 0).any():
        raise ValueError("a column sum is zero")
    scale = (float(np.median(sums)) if size == "median" else float(size)) / sums
    return m.map(lambda x: x * scale)


def log_counts(m: BigMatrix, add: float = 1.0) -> BigMatrix:
    return m.with_df(m.df.select("row_idx", F.transform("v", lambda x: F.log(x + add)).alias("v")))


def counts_of_log(m: BigMatrix) -> BigMatrix:
    return m.with_df(m.df.select("row_idx", F.transform("v", lambda x: F.exp(x) - 1).alias("v")))


def counts_of_log2(m: BigMatrix) -> BigMatrix:
    return m.with_df(m.df.select("row_idx", F.transform("v", lambda x: F.pow(F.lit(2.0), x) - 1).alias("v")))


def add_row_means(m: BigMatrix, means) -> BigMatrix:
    """m with each row's mean from (row_idx, mean) added to its cells."""
    met = m.df.join(means.select("row_idx", "mean"), "row_idx")
    return m.with_df(met.select("row_idx", F.transform("v", lambda x: x + F.col("mean")).alias("v")))


def permuted_columns(n: int, groups: list[list[int]] | None, seed: int, round_: int) -> np.ndarray:
    """A seeded permutation of column places, within groups if these are given."""
    rng = np.random.default_rng([seed, round_])
    out = np.arange(n)
    for g in groups or [list(range(n))]:
        out[g] = np.asarray(g)[rng.permutation(len(g))]
    return out
