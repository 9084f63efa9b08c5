"""Row and column access, and predicates on rows."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..matrix import BigMatrix


def read_block(m: BigMatrix, start: int, stop: int, col_ids: Sequence[int] = (), adjust: str | None = None) -> BigMatrix:
    """Rows [start, stop) of some columns in the order asked for, then adjusted by row."""
    from .rowops import adjust_rows

    got = m.rows(start, stop).columns(col_ids)
    return adjust_rows(got, adjust) if adjust else got


def take_rows(m: BigMatrix, row_ids: Sequence[int] | DataFrame, adjust: str | None = None) -> DataFrame:
    """(pos, row_idx, v) for a list of row ids: its order and repeats are kept, unknown ids drop out.

    A long list may come as a DataFrame (pos, row_idx).
    """
    from .rowops import adjust_rows

    spark = m.df.sparkSession
    ids = row_ids if isinstance(row_ids, DataFrame) else spark.createDataFrame(list(enumerate(row_ids)), "pos bigint, row_idx bigint")
    source = adjust_rows(m, adjust) if adjust else m
    return ids.join(source.df, "row_idx").select("pos", "row_idx", "v")


def column_vector(m: BigMatrix, col_id: int, start: int, stop: int) -> DataFrame:
    return m.rows(start, stop).columns([col_id]).df.select("row_idx", F.get("v", F.lit(0)).alias("value"))


def gather_ranges(m: BigMatrix, ranges: Sequence[tuple[int, int]]) -> BigMatrix:
    """Rows of several half-open ranges that do not overlap; the ranges become one pushed predicate."""
    ordered = sorted(ranges)
    if any(b > c for (_, b), (c, _) in zip(ordered, ordered[1:])):
        raise ValueError("ranges overlap")
    test = F.lit(False)
    for a, b in ordered:
        test = test | ((F.col("row_idx") >= a) & (F.col("row_idx") < b))
    return m.with_df(m.df.where(test))


def rearrange_columns(m: BigMatrix, places: Sequence[int]) -> BigMatrix:
    """Columns by 0-based place; a place may repeat, a negative or unknown one gives NaN."""
    nan = F.lit(float("nan"))
    cells = [F.get("v", F.lit(p)) if 0 <= p < m.n_cols else nan for p in places]
    cols = tuple(m.cols[p] if 0 <= p < m.n_cols else (-1, "") for p in places)
    return m.with_df(m.df.select("row_idx", F.array(*cells).alias("v")), cols)


def vectors_to_matrix(vectors: Sequence[DataFrame], names: Sequence[str] | None = None) -> BigMatrix:
    """Columns (row_idx, value) side by side. All must cover the same rows: else an error at run time.

    One union and one aggregation, whatever the number of columns, instead of a chain of joins.
    """
    tagged = [d.select(F.col("row_idx").cast("bigint"), F.lit(j).alias("col"), F.col("value").cast("double")) for j, d in enumerate(vectors)]
    every = tagged[0]
    for t in tagged[1:]:
        every = every.unionByName(t)
    n = len(vectors)
    cells = [F.max(F.when(F.col("col") == j, F.col("value"))) for j in range(n)]
    out = every.groupBy("row_idx").agg(F.array(*cells).alias("v"), F.count("*").alias("n"))
    whole = F.when(F.col("n") == n, F.col("v")).otherwise(F.raise_error(F.lit("the columns do not cover the same rows")).cast("array<double>"))
    return BigMatrix.of(out.select("row_idx", whole.alias("v")), names=names or [f"c{j + 1}" for j in range(n)])


def _above(x: Column, threshold: float) -> Column:
    return (x > threshold) & ~F.isnan(x)  # Spark sorts NaN above all numbers


def rows_max_above(m: BigMatrix, threshold: float, statistic: str = "max", selector: str = "higher") -> BigMatrix:
    """Rows whose maximum is above the threshold, strictly; no other rule selects any row."""
    if (statistic, selector) != ("max", "higher"):
        return m.with_df(m.df.where(F.lit(False)))
    return m.with_df(m.df.where(F.exists("v", lambda x: _above(x, threshold))))


def rows_with_signal(m: BigMatrix, threshold: float, min_cols: int, sample: int | None = None) -> BigMatrix:
    """Rows with at least ``min_cols`` cells above the threshold; of these the ``sample`` of least hash."""
    found = m.df.where(F.size(F.filter("v", lambda x: _above(x, threshold))) >= min_cols)
    return m.with_df(found if sample is None else found.orderBy(F.xxhash64("row_idx"), "row_idx").limit(sample))


def weak_signal_rows(m: BigMatrix, low: float, high: float | None = None) -> BigMatrix:
    """Rows whose maximum lies in [low, high]; a maximum of NaN does not."""
    top = F.array_max("v")
    test = (top >= low) & ~F.isnan(top)
    return m.with_df(m.df.where(test if high is None else test & (top <= high)))


def low_count_filter(m: BigMatrix, least: float = 5.0) -> BigMatrix:
    """Rows whose maximum reaches ``least``."""
    return m.with_df(m.df.where(F.exists("v", lambda x: (x >= least) & ~F.isnan(x))))


def high_count_rows(counts: DataFrame, cutoff: float, value: str = "count") -> DataFrame:
    return counts.where(F.col(value) > cutoff)


def zero_background(m: BigMatrix, threshold: float) -> BigMatrix:
    """Cells below the threshold set to zero; NaN stays."""
    return m.with_df(m.df.select("row_idx", F.transform("v", lambda x: F.when(x < threshold, 0.0).otherwise(x)).alias("v")))


def high_variability_rows(m: BigMatrix, top: int) -> DataFrame:
    """(row_idx, variance) of the rows of greatest population variance, ties by row_idx."""
    from ..matrix import map_scalars

    return map_scalars(m.df, lambda x: {"variance": x.var(1)}, "variance double").orderBy(F.desc("variance"), "row_idx").limit(top)


def value_index(df: DataFrame, row: str, value: str) -> DataFrame:
    """(value, row_idx) ordered for lookup by value: the inverted index as a sorted table."""
    return df.select(F.col(value).cast("bigint").alias("value"), F.col(row).cast("bigint").alias("row_idx")).repartitionByRange("value", "row_idx").sortWithinPartitions("value", "row_idx")


def lookup_values(index: DataFrame, keys: Sequence[int]) -> DataFrame:
    return index.where(F.col("value").isin(list(keys)))


def parse_ids(text: str) -> list[int]:
    """"1-5,7" -> [1, 2, 3, 4, 5, 7]."""
    out: list[int] = []
    for part in filter(None, (p.strip() for p in text.split(","))):
        if found := re.fullmatch(r"(\d+)\s*-\s*(\d+)", part):
            out.extend(range(int(found[1]), int(found[2]) + 1))
        else:
            out.append(int(part))
    return out


def parse_groups(text: str) -> list[list[int]]:
    """"[1,2],[3-4]" -> [[1, 2], [3, 4]]."""
    return [parse_ids(g) for g in re.findall(r"\[([^\]]*)\]", text)]
