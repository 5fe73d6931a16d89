"""Cutting lineage in the folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """The session's checkpoint folder. Only a local session may go without one."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        path = spark.conf.get("spark.checkpoint.dir", None)
        if path is None:
            if not sc.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            path = tempfile.mkdtemp(prefix="lodestar-")
        sc.setCheckpointDir(path)
    return sc.getCheckpointDir()


def fresh(spark: SparkSession) -> str:
    """The path of a folder that isn't there yet, in the session's checkpoint folder."""
    return f"{folder(spark)}/work-{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """Like cut(), as a Parquet table in the same folder: smaller, and read by column."""
    path = fresh(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def cut(df: DataFrame) -> DataFrame:
    """df, written to the session's checkpoint folder and read from there."""
    folder(df.sparkSession)
    return df.checkpoint()


_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def tidy(spark: SparkSession) -> Iterator[None]:
    """What is built and runs inside deletes its shuffle files when it ends, not some time later."""
    before = spark.conf.get(_CLEAN, None)
    spark.conf.set(_CLEAN, "true")
    try:
        yield
    finally:
        spark.conf.unset(_CLEAN) if before is None else spark.conf.set(_CLEAN, before)
