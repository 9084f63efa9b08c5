"""Column statistics, quantiles and histograms."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..matrix import BigMatrix, block


def column_stats(m: BigMatrix, skip_nan: bool = False) -> DataFrame:
    """(col, cnt, min, max, sum) per 0-based column.

    One pass: every task sends a row per column, which the aggregation adds up. NaN counts and
    carries into min, max and sum, unless it is skipped; a column of NaN alone then has cnt 0.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            x = block(b.column(0))
            if not x.size:
                continue
            keep = ~np.isnan(x) if skip_nan else np.ones(x.shape, bool)
            got = np.stack([keep.sum(0), np.where(keep, x, np.inf).min(0), np.where(keep, x, -np.inf).max(0), np.where(keep, x, 0).sum(0)])
            total = got if total is None else np.stack([total[0] + got[0], np.minimum(total[1], got[1]), np.maximum(total[2], got[2]), total[3] + got[3]])
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.shape[1], dtype=np.int32)), pa.array(total[0].astype(np.int64)), *(pa.array(t) for t in total[1:])], ["col", "cnt", "min", "max", "sum"])

    partial = m.df.select("v").mapInArrow(run, "col int, cnt bigint, min double, max double, sum double")
    least = F.when(F.max(F.isnan("min")), float("nan")).otherwise(F.min("min"))
    return partial.groupBy("col").agg(F.sum("cnt").alias("cnt"), least.alias("min"), F.max("max").alias("max"), F.sum("sum").alias("sum"))


def tree_sum(df: DataFrame, partial: Callable[[Iterator[pa.RecordBatch]], np.ndarray | None], most: int = 64) -> np.ndarray | None:
    """Sum of one array per task: added up by at most ``most`` tasks, whose arrays reach the driver."""

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = partial(batches)
        if got is not None:
            yield pa.RecordBatch.from_arrays([pa.array([list(got.shape)], pa.list_(pa.int64())), pa.array([np.ascontiguousarray(got, float).tobytes()], pa.binary())], ["shape", "data"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, shape = None, None
        for b in batches:
            for k in range(b.num_rows):
                x = np.frombuffer(b.column(1)[k].as_py())
                total, shape = (x.copy() if total is None else total + x), b.column(0)[k].as_py()
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([shape], pa.list_(pa.int64())), pa.array([total.tobytes()], pa.binary())], ["shape", "data"])

    kind = "shape array<bigint>, data binary"
    n = max(1, min(most, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) // 4))
    rows = df.mapInArrow(first, kind).repartition(n).mapInArrow(add, kind).collect()
    return sum(np.frombuffer(r["data"]).reshape(r["shape"]) for r in rows) if rows else None


def quantiles(cells: DataFrame, fractions: Sequence[float]) -> DataFrame:
    """(col, fraction, value) of (col, value) by linear interpolation, exactly; NaN and null are skipped.

    Equal values are counted first, then ranked by a range-partitioned sort: of each column the two
    values on either side of a fraction's place are taken, and no task holds a column.
    """
    from .order import with_rank

    counts = cells.where(F.col("value").isNotNull() & ~F.isnan("value")).groupBy("col", "value").agg(F.count("*").alias("w"))
    ranked = with_rank(counts, F.col("col"), F.col("value"), weight=F.col("w"))
    ends = ranked.groupBy("col").agg(F.min("rank").alias("first"), F.sum("w").alias("n"))  # a row per column
    wanted = F.explode(F.array(*(F.lit(float(f)) for f in fractions)))
    places = ends.select("col", "first", wanted.alias("fraction"), "n").withColumn("at", F.col("fraction") * (F.col("n") - 1))
    low = places.select(F.col("col").alias("c"), "fraction", "at", (F.col("first") + F.floor("at")).alias("lo"), (F.col("first") + F.ceil("at")).alias("hi"))
    met = ranked.join(low, (F.col("col") == F.col("c")) & (F.col("rank") <= F.col("hi")) & (F.col("lo") < F.col("rank") + F.col("w")))
    # one or two rows a place: the value that holds lo, and the one that holds hi
    at_lo = F.max(F.when((F.col("rank") <= F.col("lo")) & (F.col("lo") < F.col("rank") + F.col("w")), F.col("value")))
    at_hi = F.max(F.when((F.col("rank") <= F.col("hi")) & (F.col("hi") < F.col("rank") + F.col("w")), F.col("value")))
    got = met.groupBy("col", "fraction", "at").agg(at_lo.alias("a"), at_hi.alias("b"))
    return got.select("col", "fraction", F.when(F.col("a") == F.col("b"), F.col("a")).otherwise(F.col("a") + (F.col("at") - F.floor("at")) * (F.col("b") - F.col("a"))).alias("value"))


def column_quantiles(m: BigMatrix, fractions: Sequence[float], exact: bool = True, accuracy: int = 10_000) -> DataFrame:
    """(col, fraction, value) by linear interpolation; not exact: by a sketch of bounded memory. NaN is skipped."""
    long = m.long()
    if exact:
        return quantiles(long.select("col", "value"), fractions)
    at = F.array(*(F.lit(float(f)) for f in fractions))
    found = long.where(~F.isnan("value")).groupBy("col").agg(F.percentile_approx("value", at, accuracy).alias("q"))
    return found.select("col", F.posexplode("q").alias("i", "value")).select("col", F.get(at, F.col("i")).alias("fraction"), "value")


def degree_histogram(m: BigMatrix, width: float) -> DataFrame:
    """(col, bucket, n): how many cells of each column lie in [bucket * width, (bucket + 1) * width)."""
    return m.long().groupBy("col", F.floor(F.col("value") / width).alias("bucket")).agg(F.count("*").alias("n"))


def values_at_rank_of(m: BigMatrix, ref_col: int, ref_value: float) -> DataFrame:
    """(col, value): in every column the quantile whose fraction ref_value has in column ref_col.

    The fraction is the share of cells below ref_value among all but one, at most 1.
    """
    got = m.df.select(F.get("v", F.lit(ref_col)).alias("x")).agg(F.count("*").alias("n"), F.count_if(F.col("x") < ref_value).alias("below")).first()
    fraction = min(1.0, got["below"] / max(got["n"] - 1, 1))
    return quantiles(m.long().select("col", "value"), [fraction]).select("col", "value")
