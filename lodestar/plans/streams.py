"""Queries that run streams over the events, written out as files first, and read what the streams have written."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.fixtures import read
from lodestar.sources.scratch import fresh
from lodestar.streaming import jobs as X

EVENT = "event_id long, user_id long, event_type string, value double, props string"


def arrivals(spark: SparkSession, sf_dir: str, path: str, deliveries: int = 4) -> int:
    """All events in a few deliveries, and every fifth a second time in one of its own, as after a delivery that was repeated.

    Returns the files of a delivery: one for each task that reads the events, so that no task writes or reads a whole delivery of a
    large table; a small table has one.
    """
    events = read(spark, sf_dir, "events").select(*[c.split()[0] for c in EVENT.split(", ")])
    parts = max(1, events.rdd.getNumPartitions())
    events.repartition(deliveries * parts, "user_id").write.parquet(path)
    events.where("event_id % 5 = 0").write.mode("append").parquet(path)
    return parts


def enriched_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with the number in their props, each once; a file whose props are no JSON is set aside as a whole."""
    src, out, dead, ck = (f"{fresh(spark)}/{x}" for x in ("src", "out", "dead", "ck"))
    parts = arrivals(spark, sf_dir, src)
    odd = read(spark, sf_dir, "events").where("event_id % 1000 = 0").select((-F.col("event_id") - 1).alias("event_id"), "user_id", "event_type", "value", F.lit("{").alias("props"))

    def number(batch: DataFrame) -> DataFrame:
        doc = F.from_json("props", "k int", {"mode": "FAILFAST"})
        return batch.select("event_id", "user_id", doc["k"].alias("k"), F.floor("value").cast("long").alias("whole"))

    def run() -> None:
        X.stream_enrich(X.stream_ingest(spark, src, EVENT, files_per_batch=parts), number, out, dead, ck, key="event_id", attempts=2, delay=0).awaitTermination()

    # A batch is set aside as a whole: the odd file comes when all others are through, so that it is one of its own.
    run()
    odd.coalesce(1).write.mode("append").parquet(src)
    run()
    good = spark.read.schema("event_id long, user_id long, k int, whole long").parquet(out).select("event_id", "user_id", "k", "whole", F.lit(False).alias("aside"))
    bad = spark.read.schema("row string").parquet(dead).select(F.from_json("row", EVENT).alias("r")).select("r.event_id", "r.user_id", F.lit(None).cast("int").alias("k"), F.lit(None).cast("long").alias("whole"), F.lit(True).alias("aside"))
    return good.unionByName(bad)


def running_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per user and kind of event the number of events, their sum in cents and the last one, kept up to date batch by batch."""
    src, out, ck = (f"{fresh(spark)}/{x}" for x in ("src", "out", "ck"))
    parts = arrivals(spark, sf_dir, src)
    measures = {"n": (F.lit(1).cast("long"), "sum"), "cents": (F.round(F.col("value") * 100).cast("long"), "sum"), "last_event": (F.col("event_id"), "max")}
    events = X.once(X.stream_ingest(spark, src, EVENT, files_per_batch=2 * parts), "event_id")
    X.running_aggregates(events, ["user_id", "event_type"], measures, out, ck, buckets=8).awaitTermination()
    return X.read_running(spark, out)


QUERIES = {
    "x02_x03_enriched_stream": (
        enriched_stream,
        """SELECT event_id, user_id, CAST(json_extract_string(props, '$.k') AS INT) AS k, CAST(floor(value) AS BIGINT) AS whole, false AS aside FROM events
        UNION ALL SELECT -event_id - 1, user_id, NULL, NULL, true FROM events WHERE event_id % 1000 = 0""",
    ),
    "x01_x04_x05_running_table": (
        running_table,
        "SELECT user_id, event_type, count(*) AS n, CAST(sum(round(value * 100)) AS BIGINT) AS cents, max(event_id) AS last_event FROM events GROUP BY ALL",
    ),
}
