"""Connected components by least-label joins."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, met


#: Ids that a task holds at once.
HELD = 1_000_000


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Union-find over the edges of a task, given out as stars. Where it would hold more than HELD ids it starts anew."""
    up: dict = {}

    def top(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def stars() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(up), kind), pa.array([top(x) for x in up], kind)], ["id", "comp"])

    kind = pa.int64()
    for batch in batches:
        kind = batch.schema.field(0).type
        if up and len(up) + 2 * batch.num_rows > HELD:
            yield stars()
            up.clear()
        for x, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            up.setdefault(x, x)
            up.setdefault(y, y)
            x, y = top(x), top(y)
            if x != y:
                up[max(x, y)] = min(x, y)
    yield stars()


def components(edges: DataFrame, a: str = "a", b: str = "b", out: str = "comp", one_task: int = HELD // 2) -> DataFrame:
    """(id, out) for every id in an edge: the least id that it reaches.

    Each partition joins its own edges first, which leaves a star per local component. Up to `one_task` of these are joined in
    one task, a bounded amount; more take the rounds below, to the same result.

    Each round takes the least label around every id (map-side aggregated, so a hub is a row per task) and then the label of
    that label, until no label changes. Only a count reaches the driver. No edges give no rows.
    """
    kind = dict(edges.dtypes)[a]
    edges = cut(edges.select(F.col(a).alias(a), F.col(b).alias(b)).mapInArrow(_joined, f"id {kind}, comp {kind}"))
    if edges.count() <= one_task:
        return cut(edges.repartition(1).mapInArrow(_joined, f"id {kind}, comp {kind}").withColumnRenamed("comp", out))
    a, b = "id", "comp"
    both = cut(edges.select(F.col(a).alias("id"), F.col(b).alias("to")).unionByName(edges.select(F.col(b).alias("id"), F.col(a).alias("to"))).distinct())
    labels = cut(both.groupBy("id").agg(F.least("id", F.min("to")).alias(out)))
    while True:
        near = met(both, labels, "id").groupBy("to").agg(F.min(out).alias("near")).withColumnRenamed("to", "id")
        new = met(labels, near, "id", "left").select("id", F.col(out).alias("old"), F.least(out, "near").alias(out))
        jump = labels.select(F.col("id").alias(out), F.col(out).alias("far"))
        new = cut(met(new, jump, out, "left").select("id", "old", F.least(out, "far").alias(out)))
        if new.where(F.col("old") != F.col(out)).isEmpty():
            return new.select("id", out)
        labels = new.select("id", out)
