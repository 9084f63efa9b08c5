"""Column statistics of a stream of rows: our own addition, since the sums of a batch simply add up."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..matrix import BigMatrix
from ..operators.stats import column_stats


def merge_stats(parts: DataFrame) -> DataFrame:
    """Statistics of parts put together; a part's NaN stays, as it does within a batch."""
    least = F.when(F.max(F.isnan("min")), float("nan")).otherwise(F.min("min"))  # NaN is the greatest number to Spark
    return parts.groupBy("col").agg(F.sum("cnt").alias("cnt"), least.alias("min"), F.max("max").alias("max"), F.sum("sum").alias("sum"))


def keep_column_stats(stream: DataFrame, path: str, checkpoint: str, n_cols: int):
    """A query that writes each batch's statistics under path/batch=<id>; a batch run twice overwrites itself."""

    def each(batch: DataFrame, number: int) -> None:
        column_stats(BigMatrix.of(batch, n_cols)).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).start()


def current_stats(spark, path: str) -> DataFrame:
    return merge_stats(spark.read.parquet(path))
