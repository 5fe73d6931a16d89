"""Incremental processing: file streams, enrichment per micro-batch, dead letters, running aggregates, duplicates."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from time import sleep as pause

from py4j.java_gateway import is_instance_of
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lodestar.sources import files

#: State in RocksDB; writing a key doesn't first look it up for a count of all keys, which nothing here needs. Commits stay whole
#: (no changelog): after a batch that failed, Spark 4.1.2 may not load a store by replaying one.
STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.trackTotalNumberOfRows": "false",
}


@contextmanager
def _state_on_disk(spark: SparkSession) -> Iterator[None]:
    """Queries that start inside keep their state in RocksDB, off the heap; a query takes its settings along when it starts."""
    before = {k: spark.conf.get(k, None) for k in STATE}
    for k, v in STATE.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def stream_ingest(spark: SparkSession, path: str, schema: str, kind: str = "parquet", files_per_batch: int | None = None) -> DataFrame:
    """Every new file once; the query's checkpoint is the ledger."""
    reader = spark.readStream.schema(schema).format(kind)
    return (reader.option("maxFilesPerTrigger", files_per_batch) if files_per_batch else reader).load(path)


def storage_fault(error: BaseException) -> bool:
    """Whether a failure comes from files or disks and not from the rows: then the batch isn't to blame and waits for a restart."""
    if isinstance(error, OSError):
        return True
    if re.search(r"PythonException|Python worker", str(error)):
        return False
    cause = getattr(error, "java_exception", None) or getattr(error, "_origin", None)
    while cause is not None and hasattr(cause, "getCause"):
        # Not all of these come from files: parsers of JSON report a malformed row as one, too.
        if is_instance_of(SparkSession.active()._sc._gateway, cause, "java.io.IOException") and re.match(r"java\.(io|nio)\.|org\.apache\.hadoop\.", cause.getClass().getName()):
            return True
        cause = cause.getCause()
    # What failed in a task may reach the driver as text only.
    return bool(re.search(r"java\.(io|nio\.file)\.\w*(IOException|FileSystemException|FileNotFoundException|AccessDeniedException)", str(error)))


def once(source: DataFrame, key: str, ts: str | None = None, lateness: str | None = None) -> DataFrame:
    """The first row of each key, over all batches; the keys seen are the query's state. With a time column and a bound on lateness
    keys are forgotten once the watermark has passed them, so that state doesn't grow without end. Of rows without a key, equal ones
    count once."""
    own = F.when(F.col(key).isNull(), F.md5(F.to_json(F.struct(*source.columns)).cast("binary")))
    rows = source.withColumn("_no_key", own)
    if ts is None:
        return rows.dropDuplicates([key, "_no_key"]).drop("_no_key")
    return rows.withWatermark(ts, lateness).dropDuplicatesWithinWatermark([key, "_no_key"]).drop("_no_key")


def stream_enrich(
    source: DataFrame, enrich: Callable[[DataFrame], DataFrame], out: str, dead: str, checkpoint: str, key: str = "record_id", attempts: int = 5, delay: float = 0.2, ts: str | None = None, lateness: str | None = None
) -> StreamingQuery:
    """Enrich each micro-batch and write it to out once; a batch that keeps failing goes to the dead letters.

    Duplicates by key are dropped in the query's state. A batch is one partition of the output (_run, from the checkpoint, and
    _batch), and writing it replaces just that partition: a batch that runs again after a crash between its write and its commit
    adds nothing twice, and nothing written before is read. Only where other checkpoints have written to the same output are the
    keys of their partitions read and left out.

    Failures of the rows or of enrich are tried again `attempts` times, with pauses that double from `delay` seconds; then the batch
    is set aside, as JSON, and the stream goes on. Failures of the storage stop the query instead and put nothing aside; it goes on
    with the same batch when it is started again. A batch is in one of both tables, whatever an attempt cut short had written.
    """
    spark = source.sparkSession
    run = hashlib.md5(checkpoint.rstrip("/").encode()).hexdigest()[:12]

    def place(df: DataFrame, n: int, path: str) -> None:
        rows = df.withColumns({"_run": F.lit(run), "_batch": F.lit(n)})
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("_run", "_batch").parquet(path)

    def one(batch: DataFrame, n: int) -> None:
        session, error = batch.sparkSession, ""
        others = [f"{out}/{d}" for d in files.names(session, out) if d.startswith("_run=") and d != f"_run={run}"]
        for k in range(attempts):
            try:
                rows = enrich(batch)
                if others:
                    there = session.read.schema(f"`{key}` {dict(rows.dtypes)[key]}").parquet(*others).select(key)
                    rows = rows.join(there, key, "left_anti")
                place(rows, n, out)
                files.delete(session, f"{dead}/_run={run}/_batch={n}")
                return
            except Exception as e:
                if storage_fault(e):
                    raise
                error = str(e)[:500]
                if k + 1 < attempts:
                    pause(delay * 2**k)
        files.delete(session, f"{out}/_run={run}/_batch={n}")
        place(batch.select(F.to_json(F.struct("*")).alias("row"), F.lit(n).alias("batch"), F.lit(attempts).alias("attempts"), F.lit(error).alias("error")), n, dead)

    with _state_on_disk(spark):
        return once(source, key, ts, lateness).writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


# --- running aggregates ------------------------------------------------------------------------------------------------

#: How two partial results of a kind become one.
MERGES: dict[str, Callable[[str], Column]] = {"sum": F.sum, "min": F.min, "max": F.max}


def _manifests(spark: SparkSession, out: str) -> list[int]:
    return sorted(int(m[1]) for m in (re.fullmatch(r"(\d+)\.json", x) for x in files.names(spark, f"{out}/_manifests")) if m)


def manifest(spark: SparkSession, out: str, version: int | None = None) -> dict:
    """The newest published version of a running table: its checkpoint, its schema, and the folder of each bucket."""
    have = _manifests(spark, out)
    if not have:
        return {"version": -1, "buckets": {}}
    return json.loads(files.read_text(spark, f"{out}/_manifests/{have[-1] if version is None else version}.json"))


def read_running(spark: SparkSession, out: str, version: int | None = None) -> DataFrame:
    """The table as its newest (or a given) version has it, whatever is being written meanwhile."""
    m = manifest(spark, out, version)
    if m["version"] < 0:
        raise ValueError(f"nothing is published in {out} yet")
    paths = [f"{out}/{folder}" for folder in m["buckets"].values()]
    return spark.read.schema(m["schema"]).parquet(*paths) if paths else spark.createDataFrame([], m["schema"])


def drop_old_versions(spark: SparkSession, out: str, keep: int = 2) -> list[str]:
    """Delete manifests but the newest `keep`, and the folders that none of these needs. Returns the folders."""
    have = _manifests(spark, out)
    needed = {f for v in have[-keep:] for f in manifest(spark, out, v)["buckets"].values()}
    for v in have[:-keep]:
        files.delete(spark, f"{out}/_manifests/{v}.json")
    gone = [f"{v}/{b}" for v in files.names(spark, out) if re.fullmatch(r"v\d+", v) and int(v[1:]) <= (have or [-1])[-1] for b in files.names(spark, f"{out}/{v}") if b.startswith("bucket=") and f"{v}/{b}" not in needed]
    for folder in gone:
        files.delete(spark, f"{out}/{folder}")
    return gone


def running_aggregates(source: DataFrame, keys: list[str], measures: dict[str, tuple[Column, str]], out: str, checkpoint: str, buckets: int = 16, keep: int = 3) -> StreamingQuery:
    """measures (name: value and sum, min or max) per keys over all batches so far, read with read_running().

    A batch is aggregated by itself; the few keys that it touches fall into hash buckets, and only these buckets of the table are
    read, merged and written, into new folders. Then one manifest that names the folder of every bucket is published by a rename:
    readers see the table before the batch or after it. A batch whose manifest is there already has been counted, so a batch that
    runs again after a crash adds nothing. Null keys are a key. The newest `keep` versions stay for readers that have begun.
    """
    spark = source.sparkSession

    def merged(df: DataFrame) -> DataFrame:
        return df.groupBy(*keys).agg(*[MERGES[kind](name).alias(name) for name, (_, kind) in measures.items()])

    def one(batch: DataFrame, n: int) -> None:
        session, now = batch.sparkSession, manifest(batch.sparkSession, out)
        if now["version"] >= 0 and now["checkpoint"] != checkpoint:
            raise ValueError(f"{out} belongs to the checkpoint {now['checkpoint']}")
        if now["version"] >= n:
            return
        fresh = merged(batch.select(*keys, *[value.alias(name) for name, (value, _) in measures.items()]))
        schema = ", ".join(f"`{c}` {t}" for c, t in fresh.dtypes)
        if now["version"] >= 0 and now["schema"] != schema:
            raise ValueError(f"{out} has the columns {now['schema']}, not {schema}")
        bucket = F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")
        fresh = fresh.withColumn("bucket", bucket).persist()  # a batch's keys; used for the list of buckets and for the merge
        touched = sorted(r["bucket"] for r in fresh.select("bucket").distinct().collect())  # `buckets` rows at most
        old = [f"{out}/{now['buckets'][str(b)]}" for b in touched if str(b) in now["buckets"]]
        rows = fresh.drop("bucket")
        rows = merged(rows.unionByName(session.read.schema(schema).parquet(*old))) if old else rows
        rows.select("*", bucket.alias("bucket")).repartition(max(1, len(touched)), "bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{out}/v{n}")
        fresh.unpersist()
        now = {"version": n, "checkpoint": checkpoint, "schema": schema, "buckets": now["buckets"] | {str(b): f"v{n}/bucket={b}" for b in touched}}
        files.publish_text(session, f"{out}/_manifests/{n}.json", json.dumps(now))
        drop_old_versions(session, out, keep)

    return source.writeStream.outputMode("update").foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def running_counts(source: DataFrame, key: str, out: str, checkpoint: str, spark: SparkSession) -> StreamingQuery:
    """Counts per key over all batches so far."""
    return running_aggregates(source, [key], {"count": (F.lit(1).cast("long"), "sum")}, out, checkpoint)


def stream_dedup(source: DataFrame, key: str, ts: str, delay: str) -> DataFrame:
    """The first row per key; state is dropped once the watermark has passed."""
    return source.withWatermark(ts, delay).dropDuplicatesWithinWatermark([key])
