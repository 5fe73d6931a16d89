"""Small helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: a run of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def folder(spark: SparkSession) -> str:
    """The session's checkpoint folder: spark.checkpoint.dir, which all executors share. Only a local session may go without one."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        path = spark.conf.get("spark.checkpoint.dir", None)
        if path is None:
            if not sc.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            path = tempfile.mkdtemp(prefix="lodestar-")
        sc.setCheckpointDir(path)
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Write df to the shared checkpoint folder and go on from there."""
    folder(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """Like cut(), as a Parquet table in the same folder: smaller than a checkpoint, for large results.

    The tables are scratch: results that are not yet written read them. Once all are, the folder can go.
    """
    path = f"{folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def met(left: DataFrame, right: DataFrame, on: str | list[str] | Column, how: str = "inner") -> DataFrame:
    """left.join(right), always by a shuffle of both: a side that is broadcast passes through the driver, which holds it several times."""
    return left.join(right.hint("merge"), on, how)


def drop(df: DataFrame) -> None:
    """Delete the table that stored() wrote; nothing may read df, or what is built on it, afterwards."""
    jvm, hadoop = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
    for folder_ in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        where = jvm.org.apache.hadoop.fs.Path(folder_)
        where.getFileSystem(hadoop).delete(where, True)


#: Most rows and bytes of an Arrow batch. Each task holds a batch of whole texts several times over, in the JVM's memory beside its
#: heap and in its Python worker, and neither gives all of it back; the usual 10,000 rows and 64 MB take hundreds of MB an executor.
BATCH_LIMITS = {"spark.sql.execution.arrow.maxRecordsPerBatch": 1024, "spark.sql.execution.arrow.maxBytesPerBatch": 8 << 20}


def bounded_batches(spark: SparkSession) -> None:
    """Lower the session's limits of Arrow batches to BATCH_LIMITS where they are higher or off; lower ones stay."""
    for key, most in BATCH_LIMITS.items():
        now = int(str(spark.conf.get(key)).lower().rstrip("b"))
        if not 0 < now <= most:
            spark.conf.set(key, str(most))


def unused(df: DataFrame, name: str) -> str:
    """A column name like name that df doesn't have, in any spelling."""
    have = {c.lower() for c in df.columns}
    while name.lower() in have:
        name += "_"
    return name


def n_words(text: Column) -> Column:
    """Words of a text; null and empty texts have none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def ranked(df: DataFrame, col: str, out: str) -> DataFrame:
    """Number the rows by col from 0 without one task for all: range partitions, their counts, then ranks inside each.

    Only one row per partition (its count) passes through the driver.
    """
    from pyspark.sql import Window

    parts = cut(df.repartitionByRange(F.col(col).asc_nulls_last()).withColumn("_p", F.spark_partition_id()))
    counts, at, starts = {r["_p"]: r["count"] for r in parts.groupBy("_p").count().collect()}, 0, {}
    for p in sorted(counts):
        starts[p], at = at, at + counts[p]
    if not starts:
        return parts.withColumn(out, F.lit(0).cast("long")).drop("_p")
    start = F.create_map(*[F.lit(x).cast("long") for kv in starts.items() for x in kv])[F.col("_p").cast("long")]
    order = Window.partitionBy("_p").orderBy(F.col(col).asc_nulls_last())
    return parts.withColumn(out, start + F.row_number().over(order) - 1).drop("_p")
