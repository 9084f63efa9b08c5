"""Scratch tables in the cluster's shared folder."""

from __future__ import annotations

import atexit
import contextlib
import shutil
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

_own_scratch: list[str] = []
#: scratch tables of this process that are not deleted yet: (JVM, Hadoop's settings) by path
_written: dict[str, tuple] = {}


def scratch_root(spark: SparkSession) -> str:
    """The shared folder that the cluster names in spark.checkpoint.dir.

    Only where the setting is absent and the master is a plain local one (as in tests) a
    temporary folder of this process serves instead; on any other master its absence is an error.
    """
    conf = spark.sparkContext.getConf()
    root = conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not conf.get("spark.master", "local").startswith("local") or "cluster" in conf.get("spark.master", ""):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    if not _own_scratch:
        _own_scratch.append(tempfile.mkdtemp(prefix="matloom-"))
        atexit.register(shutil.rmtree, _own_scratch[0], True)
    return "file://" + _own_scratch[0]


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path of its own in the shared folder, deleted with the scratch tables."""
    path = f"{scratch_root(spark)}/matloom-{name}-{uuid.uuid4().hex}"
    _written[path] = (spark._jvm, spark._jsc.hadoopConfiguration())
    return path


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._matloom_path = path
    return out


def _delete(path: str) -> None:
    jvm, settings = _written.pop(path)
    jvm_path = jvm.org.apache.hadoop.fs.Path(path)
    jvm_path.getFileSystem(settings).delete(jvm_path, True)


def release(*frames: DataFrame) -> None:
    """Delete scratch tables that no later step reads."""
    for df in frames:
        if getattr(df, "_matloom_path", None) in _written:
            _delete(df._matloom_path)


def release_all() -> None:
    """Delete the scratch tables that results not yet written may still read; done at the end of the process, too."""
    for path in list(_written):
        with contextlib.suppress(Exception):
            _delete(path)


atexit.register(release_all)


@contextlib.contextmanager
def scratch_scope(*keep: DataFrame) -> Iterator[list[DataFrame]]:
    """Deletes at its end the scratch tables written within it, but for those of the frames in the list that it gives."""
    before, kept = set(_written), list(keep)
    try:
        yield kept
    finally:
        spared = before | {getattr(df, "_matloom_path", None) for df in kept}
        for path in [p for p in _written if p not in spared]:
            _delete(path)
