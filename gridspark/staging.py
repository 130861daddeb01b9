"""Tables written between the steps of a job, in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

#: Paths of the tables of the innermost scratch block that is open in this thread.
_scratch: ContextVar[list[str] | None] = ContextVar("gridspark_scratch", default=None)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir); a local session may leave it unset."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="gridspark-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def staged_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/gridspark-{label}-{uuid.uuid4().hex}"


def staged(df: DataFrame, label: str, keep: bool = False) -> DataFrame:
    """df written as Parquet in the shared folder and read again: lineage ends here and survives lost executors.

    Within a scratch block, a table that the block's result still reads must be kept.
    """
    spark, held = df.sparkSession, _scratch.get()
    path = staged_path(spark, label)
    if held is not None and not keep:
        held.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


@contextmanager
def scratch(spark: SparkSession):
    """Tables staged within, in this thread, are deleted at the end, but for the kept ones."""
    paths: list[str] = []
    token = _scratch.set(paths)
    try:
        yield
    finally:
        _scratch.reset(token)
        for path in paths:
            delete(spark, path)
