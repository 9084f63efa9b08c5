"""Sorted orders, ranks and concordance."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import materialize


def with_rank(df: DataFrame, *keys: Column, weight: Column | None = None) -> DataFrame:
    """df with rank: the rows before each in the order of keys, or the sum of their weights.

    Ranks come from a range-partitioned sort, sums within its partitions and the totals of the
    partitions before: no task holds more than a partition. Keys should order all rows that differ.
    """
    names = [f"_k{i}" for i in range(len(keys))]
    keyed = df.select("*", *(k.alias(n) for k, n in zip(keys, names)), (F.lit(1) if weight is None else weight).cast("bigint").alias("_w"))
    placed = keyed.repartitionByRange(*names).sortWithinPartitions(*names)
    placed = placed.select("*", F.spark_partition_id().alias("_p"), F.monotonically_increasing_id().alias("_n"))
    placed = materialize(placed, "ranked")  # read twice, and numbered once
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    starts = placed.groupBy("_p").agg(F.sum("_w").alias("_t")).select("_p", F.coalesce(F.sum("_t").over(before), F.lit(0)).alias("_s"))
    within = Window.partitionBy("_p").orderBy("_n").rowsBetween(Window.unboundedPreceding, -1)
    inside = F.col("_n").bitwiseAND((1 << 33) - 1) if weight is None else F.coalesce(F.sum("_w").over(within), F.lit(0))
    return placed.withColumn("_in", inside).join(starts, "_p").withColumn("rank", F.col("_s") + F.col("_in")).drop("_p", "_n", "_w", "_s", "_in", *names)


def arg_sort(df: DataFrame, value: str, row: str = "row_idx", descending: bool = False) -> DataFrame:
    """(rank, row, value) from 0, ties by row; NaN last."""
    col = F.col(value)
    key = F.when(F.isnan(col), None).otherwise(-col if descending else col)
    return with_rank(df.select(F.col(row), col), key.isNull(), key, F.col(row)).select("rank", F.col(row), col)


def average_rank(df: DataFrame, value: str) -> DataFrame:
    """df with rank: 1-based, ties share their mean rank."""
    counts = df.groupBy(value).agg(F.count("*").alias("_c"))
    ranks = with_rank(counts, F.col(value), weight=F.col("_c")).select(value, (F.col("rank") + (F.col("_c") + 1) / 2).alias("rank"))
    return df.join(ranks, value)


def concordance_at_top(a: DataFrame, b: DataFrame, sizes: Sequence[int], row: str = "row_idx") -> DataFrame:
    """(size, share): share of the top ``size`` rows of a that are among the top ``size`` of b; both hold rank from 1."""
    met = a.select(row, F.col("rank").alias("ra")).join(b.select(row, F.col("rank").alias("rb")), row)
    worst = met.select(F.greatest("ra", "rb").alias("w")).where(F.col("w") <= max(sizes))
    got = worst.agg(*(F.count_if(F.col("w") <= s).alias(f"s{s}") for s in sizes))
    return got.select(F.explode(F.array(*(F.struct(F.lit(s).alias("size"), (F.col(f"s{s}") / s).alias("share")) for s in sizes))).alias("x")).select("x.*")


def top_rows(df: DataFrame, value: str, n: int, row: str = "row_idx") -> DataFrame:
    return df.orderBy(F.desc(value), row).limit(n)
