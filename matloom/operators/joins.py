"""Joins by position, by row id, by name and by range."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..matrix import BigMatrix


def bind_columns(left: BigMatrix, right: BigMatrix) -> BigMatrix:
    """Two matrices over the same rows side by side; rows of one only are an error at run time."""
    a, b = left.df.select("row_idx", F.col("v").alias("a")), right.df.select("row_idx", F.col("v").alias("b"))
    met = a.join(b, "row_idx", "full")
    both = F.when(F.col("a").isNotNull() & F.col("b").isNotNull(), F.concat("a", "b")).otherwise(F.raise_error(F.lit("row domains differ")).cast("array<double>"))
    cols = tuple((j + 1, n) for j, (_, n) in enumerate(left.cols + right.cols))
    return BigMatrix(met.select("row_idx", both.alias("v")), cols)


def name_to_id(df: DataFrame, dim: DataFrame, name: str, dim_name: str = "name", dim_id: str = "id") -> DataFrame:
    """df with a column id from the dimension, -1 where the name is unknown."""
    d = dim.select(F.col(dim_name).alias("_name"), F.col(dim_id).alias("_id"))
    return df.join(d, F.col(name) == F.col("_name"), "left").withColumn("id", F.coalesce("_id", F.lit(-1))).drop("_name", "_id")


def in_ranges(points: DataFrame, ranges: DataFrame, point: str, start: str, stop: str, width: int, on: str | None = None) -> DataFrame:
    """Each point with the half-open ranges [start, stop) that hold it.

    Ranges are cut at multiples of ``width`` and joined by cell, so that the join is an equi-join
    at any size; choose the width near the usual range length.
    """
    cells = F.explode(F.sequence(F.floor(F.col(start) / width), F.floor((F.col(stop) - 1) / width)))
    r = ranges.where(F.col(start) < F.col(stop)).withColumn("_cell", cells)
    p = points.withColumn("_cell", F.floor(F.col(point) / width))
    met = p.join(r, ["_cell", on] if on else "_cell")
    return met.where((F.col(point) >= F.col(start)) & (F.col(point) < F.col(stop))).drop("_cell")


def associate(responses: DataFrame, predictors: DataFrame, key: str, least: int = 1) -> DataFrame:
    """(key, row_idx, n): the predictor rows of each response that has at least ``least`` of them, n in all.

    One row per pair, so that a key with very many predictors is no single value; n comes from a
    count per key, joined like the keys themselves.
    """
    rows = predictors.select(key, "row_idx")
    enough = rows.groupBy(key).agg(F.count("*").alias("n")).where(F.col("n") >= least).join(responses.select(key).distinct(), key)
    return rows.join(enough, key).select(key, "row_idx", "n")
