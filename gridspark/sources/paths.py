"""Paths of any file system that Spark reaches."""

from __future__ import annotations

from pyspark.sql import SparkSession


def _at(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def qualified(spark: SparkSession, path: str) -> str:
    """The whole URI of a path, without . and .. parts."""
    fs, p = _at(spark, path)
    return str(spark._jvm.org.apache.hadoop.fs.Path(fs.makeQualified(p).toUri().normalize()).toString()).rstrip("/")


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _at(spark, path)
    return fs.exists(p)


def names(spark: SparkSession, folder: str) -> list[str]:
    """Names in a folder, sorted; none if it is not there."""
    fs, p = _at(spark, folder)
    return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []


def files_of(spark: SparkSession, path: str) -> str:
    """A pattern of a table's files, whether it is one file or a folder."""
    fs, p = _at(spark, path)
    return f"{path}/*" if fs.getFileStatus(p).isDirectory() else path


def read_text(spark: SparkSession, path: str) -> str:
    fs, p = _at(spark, path)
    stream = fs.open(p)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """The file appears whole: it is written beside its place and renamed."""
    fs, p = _at(spark, path)
    part = spark._jvm.org.apache.hadoop.fs.Path(f"{path}.part")
    stream = fs.create(part, True)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()
    fs.delete(p, False)
    if not fs.rename(part, p):
        raise OSError(f"{part} could not be renamed to {path}")


def remove(spark: SparkSession, path: str) -> None:
    fs, p = _at(spark, path)
    fs.delete(p, True)
