"""The dense matrix: a DataFrame (row_idx BIGINT, v ARRAY<DOUBLE>) and its columns' ids and names."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCHEMA = "row_idx bigint, v array<double>"


def block(column: pa.Array) -> np.ndarray:
    """A batch's rows as a numpy matrix; rows of different lengths are an error."""
    if not len(column):
        return np.zeros((0, 0))
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(float, copy=False)
    width, rest = divmod(len(flat), len(column))
    if rest or column.null_count or (np.diff(column.offsets.to_numpy()) != width).any():
        raise ValueError("rows differ in length, or are null")
    return flat.reshape(len(column), width)


def as_lists(x: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, max(x.shape[1], 1), dtype=np.int32) if x.size else np.zeros(len(x) + 1, np.int32)), pa.array(x.ravel()))


def map_rows(df: DataFrame, fn: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """(row_idx, v) with v = fn(rows), batch by batch; fn sees whole rows and may not mix them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([b.column(0), as_lists(np.ascontiguousarray(fn(block(b.column(1))), float))], ["row_idx", "v"])

    return df.select("row_idx", "v").mapInArrow(run, SCHEMA)


def map_scalars(df: DataFrame, fn: Callable[[np.ndarray], dict[str, np.ndarray]], schema: str) -> DataFrame:
    """(row_idx, ...) with one value per row for each column of ``schema``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                got = fn(block(b.column(1)))
                yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(x) for x in got.values())], ["row_idx", *got])

    return df.select("row_idx", "v").mapInArrow(run, f"row_idx bigint, {schema}")


@dataclass(frozen=True)
class BigMatrix:
    """Rows are unordered in Spark: whatever depends on their order goes by row_idx, from 0."""

    df: DataFrame
    cols: tuple[tuple[int, str], ...]

    @classmethod
    def of(cls, df: DataFrame, n_cols: int | None = None, names: Sequence[str] | None = None) -> BigMatrix:
        if names is None:
            if n_cols is None:
                first = df.select(F.size("v").alias("n")).first()
                n_cols = first["n"] if first else 0
            names = [f"c{j + 1}" for j in range(n_cols)]
        return cls(df, tuple((j + 1, str(n)) for j, n in enumerate(names)))

    @classmethod
    def from_long(cls, long: DataFrame, n_cols: int, fill: float = 0.0, names: Sequence[str] | None = None) -> BigMatrix:
        """From (row_idx, col, value), col from 0 to n_cols - 1; absent cells get ``fill``, equal cells are summed."""
        cells = [F.coalesce(F.sum(F.when(F.col("col") == j, F.col("value").cast("double"))), F.lit(float(fill))) for j in range(n_cols)]
        return cls.of(long.groupBy("row_idx").agg(F.array(*cells).alias("v")), names=names or [f"c{j + 1}" for j in range(n_cols)])

    @property
    def n_cols(self) -> int:
        return len(self.cols)

    def long(self) -> DataFrame:
        """(row_idx, col, value), col from 0."""
        return self.df.select("row_idx", F.posexplode("v").alias("col", "value"))

    def with_df(self, df: DataFrame, cols: tuple[tuple[int, str], ...] | None = None) -> BigMatrix:
        return replace(self, df=df, cols=self.cols if cols is None else cols)

    def map(self, fn: Callable[[np.ndarray], np.ndarray]) -> BigMatrix:
        return self.with_df(map_rows(self.df, fn))

    def columns(self, col_ids: Sequence[int] = ()) -> BigMatrix:
        """The columns of these ids in this order; none given: all."""
        if not col_ids:
            return self
        place = {i: j for j, (i, _) in enumerate(self.cols)}
        cells = F.array(*(F.get("v", F.lit(place[i])) for i in col_ids))
        return self.with_df(self.df.select("row_idx", cells.alias("v")), tuple(self.cols[place[i]] for i in col_ids))

    def rows(self, start: int, stop: int) -> BigMatrix:
        """Rows [start, stop): a predicate on row_idx that reaches the scan."""
        if stop < start or start < 0:
            raise ValueError(f"row range [{start}, {stop}) is not valid")
        return self.with_df(self.df.where((F.col("row_idx") >= start) & (F.col("row_idx") < stop)))
