"""Per-row tests: one-way ANOVA over column groups, Welch's t over pairs of column sets."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.distributions import critical_f, sign_test, t_two_sided
from ..matrix import BigMatrix, block, map_scalars
from .stats import quantiles

EPS = float(np.finfo(float).eps)


def anova(x: np.ndarray, groups: Sequence[Sequence[int]], degenerate: float = float("nan"), least: float = EPS) -> np.ndarray:
    """F of each row over groups of 0-based columns, of which only the covered ones count.

    Rows whose within-group variance is not above ``least`` get ``degenerate``.
    """
    covered = np.concatenate([np.asarray(g, int) for g in groups])
    grand = x[:, covered].mean(1)
    between = np.zeros(len(x))
    within = np.zeros(len(x))
    for g in groups:
        y = x[:, list(g)]
        mean = y.mean(1)
        between += len(g) * (mean - grand) ** 2
        within += ((y - mean[:, None]) ** 2).sum(1)
    between /= len(groups) - 1
    within /= len(covered) - len(groups)
    flat = within <= least
    return np.where(flat, degenerate, between / np.where(flat, 1, within))


def row_anova(m: BigMatrix, groups: Sequence[Sequence[int]], **options) -> DataFrame:
    """(row_idx, f)."""
    return map_scalars(m.df, lambda x: {"f": anova(x, groups, **options)}, "f double")


def control_rows_by_anova(m: BigMatrix, groups: Sequence[Sequence[int]], p: float = 0.05, critical: float | None = None) -> DataFrame:
    """(row_idx, f, is_control): a row is a control where its F is below the critical one; NaN is none."""
    covered = sum(map(len, groups))
    crit = critical_f(p, len(groups) - 1, covered - len(groups)) if critical is None else critical
    return row_anova(m, groups).withColumn("is_control", (F.col("f") < crit) & ~F.isnan("f"))


def f_summary(fs: DataFrame) -> DataFrame:
    """Mean and median F over the rows that have one; the median by ranks, in one row like the mean."""
    ok = fs.where(~F.isnan("f"))
    middle = quantiles(ok.select(F.lit(0).alias("col"), F.col("f").alias("value")), [0.5]).agg(F.max("value").alias("median_f"))
    mean = ok.agg(F.avg("f").alias("mean_f"), F.count("*").alias("n")).select("mean_f", F.lit(None).cast("double").alias("median_f"), "n")
    both = mean.unionByName(middle.select(F.lit(None).cast("double").alias("mean_f"), "median_f", F.lit(None).cast("bigint").alias("n")))
    return both.agg(F.max("mean_f").alias("mean_f"), F.max("median_f").alias("median_f"), F.max("n").alias("n"))


def welch(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """t and degrees of freedom of each row; NaN where both sides are constant."""
    va, vb = a.var(1, ddof=1) / a.shape[1], b.var(1, ddof=1) / b.shape[1]
    se2 = va + vb
    flat = se2 <= EPS * np.maximum(np.abs(a.mean(1)), np.abs(b.mean(1))) ** 2
    safe = np.where(flat, 1, se2)
    t = np.where(flat, np.nan, (a.mean(1) - b.mean(1)) / np.sqrt(safe))
    df = np.where(flat, np.nan, safe**2 / np.maximum(va**2 / (a.shape[1] - 1) + vb**2 / (b.shape[1] - 1), 1e-300))
    return t, df


def row_welch(m: BigMatrix, pairs: Sequence[tuple[Sequence[int], Sequence[int]]]) -> DataFrame:
    """(row_idx, pair, t, df, p) for every pair of 0-based column sets, in one pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = block(batch.column(1))
            for k, (a, b) in enumerate(pairs):
                t, df = welch(x[:, list(a)], x[:, list(b)])
                p = np.where(np.isnan(t), np.nan, t_two_sided(np.nan_to_num(t), np.nan_to_num(df, nan=1.0)))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.full(len(x), k)), pa.array(t), pa.array(df), pa.array(p)], ["row_idx", "pair", "t", "df", "p"])

    return m.df.select("row_idx", "v").mapInArrow(run, "row_idx bigint, pair bigint, t double, df double, p double")


def t_errors(ts: DataFrame) -> DataFrame:
    """Mean square and mean absolute t over the rows that have one."""
    t = F.nanvl("t", F.lit(None).cast("double"))
    return ts.agg(F.avg(t * t).alias("mse"), F.avg(F.abs(t)).alias("mae"), F.count(t).alias("n"))


def compare_configs(a: DataFrame, b: DataFrame, value: str = "t") -> dict[str, float]:
    """Sign test that |b| is below |a| in more or fewer rows than by chance."""
    met = a.select("row_idx", F.abs(value).alias("a")).join(b.select("row_idx", F.abs(value).alias("b")), "row_idx").where("not isnan(a) and not isnan(b)")
    got = met.agg(F.count_if(F.col("b") < F.col("a")).alias("less"), F.count("*").alias("n")).first()
    return {"less": got["less"], "n": got["n"], "p": sign_test(got["less"], got["n"])}


def group_difference(m: BigMatrix, a: Sequence[int], b: Sequence[int]) -> DataFrame:
    """(row_idx, difference): mean of columns a less mean of columns b."""
    return map_scalars(m.df, lambda x: {"difference": x[:, list(a)].mean(1) - x[:, list(b)].mean(1)}, "difference double")
