"""Streams: batches written once, nothing reread, storage faults told from poison, tables that readers see whole."""

import glob
import os
from collections import Counter

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrameReader
from pyspark.sql import functions as F

from lodestar.plans import streams
from lodestar.sources import files
from lodestar.streaming import jobs as X

ROW = "record_id string, v int"


def add(spark, path, rows, schema=ROW):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)


def stream(spark, src, schema=ROW, n=1):
    return X.stream_ingest(spark, src, schema, files_per_batch=n)


def double(df):
    return df.withColumn("w", F.col("v") * 2)


def enriched(spark, out):
    return sorted((r.record_id, r.w) for r in spark.read.parquet(out).collect())


def test_later_batches_read_nothing_that_was_written(spark, tmp_path, monkeypatch):
    src, out, dead, ck = (str(tmp_path / x) for x in ("src", "out", "dead", "ck"))
    for k in range(4):
        add(spark, src, [(f"r{k}", k), (f"r{k}", 9), ("r0", 7)])
    read = []
    real = DataFrameReader.parquet
    monkeypatch.setattr(DataFrameReader, "parquet", lambda self, *paths, **o: read.append(paths) or real(self, *paths, **o))
    X.stream_enrich(stream(spark, src), double, out, dead, ck).awaitTermination()
    assert not read
    assert [x[0] for x in enriched(spark, out)] == ["r0", "r1", "r2", "r3"]
    batches = glob.glob(f"{out}/_run=*/_batch=*")
    assert len(batches) == 4  # a batch is a partition, and four files made four batches


def test_a_batch_that_runs_again_adds_nothing(spark, tmp_path):
    src, out, dead, ck = (str(tmp_path / x) for x in ("src", "out", "dead", "ck"))
    add(spark, src, [("a", 1), ("b", 2)])
    add(spark, src, [("b", 2), ("c", 3)])
    X.stream_enrich(stream(spark, src), double, out, dead, ck).awaitTermination()
    before = enriched(spark, out)
    for f in glob.glob(f"{ck}/commits/1") + glob.glob(f"{ck}/commits/.1.crc"):
        os.remove(f)  # as after a crash between the write and the commit
    X.stream_enrich(stream(spark, src), double, out, dead, ck).awaitTermination()
    assert enriched(spark, out) == before and len(before) == 3

    def broken(df):
        raise ValueError("poison")

    for f in glob.glob(f"{ck}/commits/1") + glob.glob(f"{ck}/commits/.1.crc"):
        os.remove(f)
    X.stream_enrich(stream(spark, src), broken, out, dead, ck, attempts=2, delay=0).awaitTermination()
    kept, aside = len(enriched(spark, out)), spark.read.parquet(dead).count()
    assert kept < 3 and kept + aside == 3  # in one of both
    for f in glob.glob(f"{ck}/commits/1") + glob.glob(f"{ck}/commits/.1.crc"):
        os.remove(f)
    X.stream_enrich(stream(spark, src), double, out, dead, ck).awaitTermination()
    assert enriched(spark, out) == before and not glob.glob(f"{dead}/_run=*/_batch=*")


def test_another_checkpoint_adds_what_is_new(spark, tmp_path):
    src, out, dead = (str(tmp_path / x) for x in ("src", "out", "dead"))
    add(spark, src, [("a", 1)])
    X.stream_enrich(stream(spark, src), double, out, dead, str(tmp_path / "c1")).awaitTermination()
    add(spark, src, [("b", 2), ("a", 1)])
    X.stream_enrich(stream(spark, src), double, out, dead, str(tmp_path / "c2")).awaitTermination()
    assert enriched(spark, out) == [("a", 2), ("b", 4)]


def test_poison_waits_longer_each_time_and_is_set_aside(spark, tmp_path, monkeypatch):
    src, out, dead, ck = (str(tmp_path / x) for x in ("src", "out", "dead", "ck"))
    add(spark, src, [("a", 1)])
    add(spark, src, [("b", 2)])
    pauses = []
    monkeypatch.setattr(X, "pause", pauses.append)

    @F.udf("int")
    def odd(v):
        if v == 1:
            raise ValueError("odd")
        return 2 * v

    X.stream_enrich(stream(spark, src), lambda df: df.withColumn("w", odd("v")), out, dead, ck, attempts=3, delay=1.0).awaitTermination()
    rows = spark.read.parquet(dead).collect()
    assert [(r.row, r.attempts) for r in rows] == [('{"record_id":"a","v":1}', 3)] and "odd" in rows[0].error
    assert pauses == [1.0, 2.0] and enriched(spark, out) == [("b", 4)]


def test_a_failing_disk_sets_nothing_aside(spark, tmp_path):
    src, out, dead, ck = (str(tmp_path / x) for x in ("src", "out", "dead", "ck"))
    add(spark, src, [("a", 1)])
    (tmp_path / "out").write_text("a file where the folder should be")
    with pytest.raises(StreamingQueryException):
        X.stream_enrich(stream(spark, src), double, out, dead, ck, delay=0).awaitTermination()
    assert not os.path.exists(dead)
    os.remove(out)
    X.stream_enrich(stream(spark, src), double, out, dead, ck, delay=0).awaitTermination()
    assert enriched(spark, out) == [("a", 2)] and not os.path.exists(dead)


def test_malformed_rows_are_poison_though_parsers_call_them_io(spark, tmp_path):
    src, out, dead, ck = (str(tmp_path / x) for x in ("src", "out", "dead", "ck"))
    add(spark, src, [("{", 1)])
    parsed = lambda df: df.withColumn("w", F.from_json("record_id", "a int", {"mode": "FAILFAST"})["a"])
    X.stream_enrich(stream(spark, src), parsed, out, dead, ck, attempts=2, delay=0).awaitTermination()
    assert spark.read.parquet(dead).count() == 1 and not glob.glob(f"{out}/_run=*/_batch=*")


def test_rows_without_a_key_count_once_if_equal(spark, tmp_path):
    src, out, dead, ck = (str(tmp_path / x) for x in ("src", "out", "dead", "ck"))
    add(spark, src, [(None, 1), (None, 1), (None, 2)])
    add(spark, src, [(None, 2), ("x", None)])
    X.stream_enrich(stream(spark, src), double, out, dead, ck).awaitTermination()
    assert Counter((r.record_id, r.v) for r in spark.read.parquet(out).collect()) == {(None, 1): 1, (None, 2): 1, ("x", None): 1}


def table(spark, out, version=None):
    return {r.k: (r.n, r.top) for r in X.read_running(spark, out, version).collect()}


def test_running_table_is_whole_and_touches_few_buckets(spark, tmp_path, monkeypatch):
    src, out, ck = (str(tmp_path / x) for x in ("src", "out", "ck"))
    measures = {"n": (F.lit(1).cast("long"), "sum"), "top": (F.col("v"), "max")}
    run = lambda: X.running_aggregates(stream(spark, src, "k string, v int"), ["k"], measures, out, ck, buckets=8).awaitTermination()
    add(spark, src, [(f"k{i}", i) for i in range(40)] + [(None, 5)], "k string, v int")
    with pytest.raises(ValueError):
        X.read_running(spark, out)
    run()
    first, v0 = table(spark, out), X.manifest(spark, out)
    assert first == {f"k{i}": (1, i) for i in range(40)} | {None: (1, 5)}
    seen, publish = [], files.publish_text

    def switched(session, path, text):
        seen.append(table(session, out))  # a reader, when all files of the batch are written and the pointer isn't yet
        publish(session, path, text)

    monkeypatch.setattr(files, "publish_text", switched)
    add(spark, src, [("k3", 99), ("k3", 1), (None, 1)], "k string, v int")
    run()
    v1 = X.manifest(spark, out)
    assert seen == [first] and table(spark, out) == first | {"k3": (3, 99), None: (2, 5)} and table(spark, out, 0) == first
    changed = {b for b in v1["buckets"] if v1["buckets"][b] != v0["buckets"].get(b)}
    assert 1 <= len(changed) <= 2 and len(v1["buckets"]) > 4
    assert len(glob.glob(f"{out}/v1/bucket=*")) == len(changed)
    for f in glob.glob(f"{ck}/commits/1") + glob.glob(f"{ck}/commits/.1.crc"):
        os.remove(f)
    run()  # the batch runs again, but has been counted
    assert table(spark, out) == first | {"k3": (3, 99), None: (2, 5)} and len(seen) == 1
    with pytest.raises(StreamingQueryException):
        X.running_aggregates(stream(spark, src, "k string, v int"), ["k"], measures, out, str(tmp_path / "other")).awaitTermination()


def test_old_versions_go_when_no_kept_one_needs_them(spark, tmp_path):
    src, out, ck = (str(tmp_path / x) for x in ("src", "out", "ck"))
    for k in range(5):
        add(spark, src, [("a", k)] + ([("b", 1)] if k == 0 else []), "k string, v int")
    X.running_aggregates(stream(spark, src, "k string, v int"), ["k"], {"n": (F.lit(1), "sum"), "top": (F.col("v"), "max")}, out, ck, buckets=64, keep=2).awaitTermination()
    assert table(spark, out) == {"a": (5, 4), "b": (1, 1)} and table(spark, out, 3) == {"a": (4, 3), "b": (1, 1)}
    assert files.names(spark, f"{out}/_manifests") == ["3.json", "4.json"]
    assert sum(len(glob.glob(f"{out}/v{k}/bucket=*")) for k in range(5)) == 3  # b of the first, a of the two last


def test_deliveries_of_a_larger_table_are_split_by_task(spark, tmp_path, monkeypatch):
    rows = spark.range(3000).selectExpr("id AS event_id", "id % 50 AS user_id", "'view' AS event_type", "id / 7 AS value", """concat('{"k": ', id % 9, '}') AS props""")
    rows.repartition(6).write.parquet(str(tmp_path / "events.parquet"))
    spark.conf.set("spark.sql.files.openCostInBytes", str(64 << 20))
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(64 << 20))  # a file is a split
    try:
        parts = streams.arrivals(spark, str(tmp_path), str(tmp_path / "src"))
        assert parts == 6 and len(glob.glob(str(tmp_path / "src/*.parquet"))) > 5 * 4
        got = Counter(tuple(r) for r in streams.enriched_stream(spark, str(tmp_path)).collect())
    finally:
        spark.conf.unset("spark.sql.files.openCostInBytes")
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == Counter([(k, k % 50, k % 9, k // 7, False) for k in range(3000)] + [(-k - 1, k % 50, None, None, True) for k in range(0, 3000, 1000)])
    assert X.STATE["spark.sql.streaming.stateStore.rocksdb.trackTotalNumberOfRows"] == "false" and spark.conf.get("spark.sql.streaming.stateStore.rocksdb.trackTotalNumberOfRows", None) is None
