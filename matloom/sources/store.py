"""Matrices kept as Parquet sorted by row, with a manifest beside them."""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..matrix import SCHEMA, BigMatrix, block


def write_text(spark: SparkSession, path: str, text: str) -> None:
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)


def read_text(spark: SparkSession, path: str) -> str:
    return "\n".join(r["value"] for r in spark.read.text(path).collect())


def _rows_of(spark: SparkSession, path: str) -> dict:
    """What the manifest says of the rows, from the statistics of the written files."""
    got = spark.read.schema(SCHEMA).parquet(f"{path}/data").agg(F.count("row_idx").alias("n"), F.min("row_idx").alias("lo"), F.max("row_idx").alias("hi")).first()
    return {"n_rows": got["n"], "first_row": got["lo"], "last_row": got["hi"]}


def save_matrix(m: BigMatrix, path: str, name: str = "matrix", **more) -> None:
    """Range-partitioned and sorted by row_idx, so that a row range prunes files and row groups.

    The manifest has the columns' ids and names, the number of rows and the least and greatest row id.
    """
    spark = m.df.sparkSession
    m.df.select("row_idx", "v").repartitionByRange("row_idx").sortWithinPartitions("row_idx").write.mode("overwrite").parquet(f"{path}/data")
    write_text(spark, f"{path}/manifest.json", json.dumps({"name": name, "cols": [list(c) for c in m.cols], **more, **_rows_of(spark, path)}))


def append_rows(m: BigMatrix, path: str) -> None:
    """More rows of the same columns; row ids must be new."""
    spark = m.df.sparkSession
    manifest = read_manifest(spark, path)
    if len(manifest["cols"]) != m.n_cols:
        raise ValueError(f"{m.n_cols} columns, not {len(manifest['cols'])}")
    m.df.select("row_idx", "v").repartitionByRange("row_idx").sortWithinPartitions("row_idx").write.mode("append").parquet(f"{path}/data")
    write_text(spark, f"{path}/manifest.json", json.dumps(manifest | _rows_of(spark, path)))


def read_manifest(spark: SparkSession, path: str) -> dict:
    return json.loads(read_text(spark, f"{path}/manifest.json"))


def load_output(spark: SparkSession, path: str) -> BigMatrix:
    manifest = read_manifest(spark, path)
    return BigMatrix(spark.read.schema(SCHEMA).parquet(f"{path}/data"), tuple((i, n) for i, n in manifest["cols"]))


def export_rows(m: BigMatrix, path: str, start: int, stop: int, col_ids=()) -> None:
    save_matrix(m.rows(start, stop).columns(col_ids), path)


def export_taken(taken: DataFrame, m: BigMatrix, path: str) -> None:
    """Rows of operators.select.take_rows in list order: pos becomes row_idx."""
    save_matrix(m.with_df(taken.select(F.col("pos").alias("row_idx"), "v")), path)


def export_zero_background(m: BigMatrix, path: str, threshold: float) -> None:
    from ..operators.select import zero_background

    save_matrix(zero_background(m, threshold), path)


def export_configs(m: BigMatrix, model, which: str, configs, path: str, **options) -> None:
    """One matrix per (k, n_known), all from one scan, as folders k=../n_known=.. ."""
    from ..operators.factor import components_of_configs

    components_of_configs(m, model, which, configs, **options).write.mode("overwrite").partitionBy("k", "n_known").parquet(path)


def read_batches(m: BigMatrix, rows: int = 100_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row ids, cells) of the rows in order, so many row ids at a time: what the driver holds of a matrix of any size."""
    ends = m.df.agg(F.min("row_idx").alias("lo"), F.max("row_idx").alias("hi")).first()
    if ends["lo"] is None:
        return
    for a in range(ends["lo"], ends["hi"] + 1, rows):
        part = m.rows(a, a + rows).df.select("row_idx", "v").orderBy("row_idx").toArrow()
        if part.num_rows:
            yield part.column("row_idx").to_numpy(), block(part.column("v").combine_chunks())


def read_ordered(m: BigMatrix) -> DataFrame:
    return m.df.orderBy("row_idx")
