"""Small file operations on whatever file system a path names, through Spark's own file system classes."""

from __future__ import annotations

from py4j.java_gateway import JavaObject
from pyspark.sql import SparkSession


def _open(spark: SparkSession, path: str) -> tuple[JavaObject, JavaObject]:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def exists(spark: SparkSession, path: str) -> bool:
    fs, where = _open(spark, path)
    return fs.exists(where)


def names(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder, sorted; none if there is no such folder."""
    fs, where = _open(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(where)) if fs.exists(where) else []


def delete(spark: SparkSession, path: str) -> None:
    fs, where = _open(spark, path)
    fs.delete(where, True)


def read_text(spark: SparkSession, path: str) -> str:
    fs, where = _open(spark, path)
    stream = fs.open(where)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def publish_text(spark: SparkSession, path: str, text: str) -> None:
    """Write a file that is there whole or not at all: under a hidden name first, renamed when it is closed."""
    fs, where = _open(spark, path)
    hidden = spark._jvm.org.apache.hadoop.fs.Path(where.getParent(), f"_{where.getName()}.tmp")
    stream = fs.create(hidden, True)
    stream.write(bytearray(text.encode()))
    stream.close()
    if not fs.rename(hidden, where):
        raise OSError(f"{path} could not be published")
