"""Files in and out: declared schemas, nested JSON, manifests."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.guards import require_columns

def read_table(spark: SparkSession, path: str, types: dict[str, str] | None = None, kind: str = "parquet") -> DataFrame:
    """A table of declared columns; CSV and JSON are read as text and cast, so nothing is inferred."""
    if kind == "parquet":
        df = spark.read.parquet(path)
        return require_columns(df, types) if types else df
    if not types:
        raise ValueError(f"{kind} needs declared columns")
    schema = ", ".join(f"`{c}` string" for c in types)
    reader = spark.read.schema(schema).option("mode", "PERMISSIVE")
    df = reader.option("header", True).option("enforceSchema", False).csv(path) if kind == "csv" else reader.json(path)
    return require_columns(df, types)


def write_table(df: DataFrame, path: str, kind: str = "parquet", partition_by: tuple[str, ...] = ()) -> None:
    writer = df.write.mode("overwrite").partitionBy(*partition_by) if partition_by else df.write.mode("overwrite")
    writer.option("header", True).csv(path) if kind == "csv" else getattr(writer, kind)(path)


def manifest(spark: SparkSession, inputs: list[str], **details) -> str:
    """JSON of input files with SHA-256 and length, and details; files are hashed by the executors."""
    files = spark.read.format("binaryFile").load(inputs).select("path", "length", F.sha2("content", 256).alias("sha256")).orderBy("path")
    return json.dumps({"inputs": [r.asDict() for r in files.toLocalIterator()], **details}, sort_keys=True, default=str)
