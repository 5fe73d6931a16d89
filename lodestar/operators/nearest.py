"""Nearest vectors by cosine: exact, with chunks of the base left out by triangle inequalities.

Vectors of length 1 have cosines that fall with their distance, so a bound on distances is one on cosines. Base rows are dealt out by
their nearest pivot and the distance to it, in range partitions, and each run of `chunk` rows is a chunk: a few rings around pivots. For
a query at distance d from a pivot, no row of a ring from lo to hi is nearer than d - hi or lo - d. A query first meets the chunk with
the least bound; its k-th cosine there rules out most others where vectors cluster, and it goes on to the rest. Each chunk is read
once in either turn and meets its queries in one sorted stream, a block at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from lodestar.sources.scratch import cut

#: Distances from cosines near 1 are right to about this much.
SLACK = 1e-7


def top_rows(own: object, sims: np.ndarray, ids: list, labels: list, k: int, others: bool, label: bool) -> list[tuple]:
    """The k best rows of one query: (own, id, label, sim), ties to the smaller id; the best of each label only, if label."""
    want = min(len(sims), k + 1)
    while True:  # more are looked at while labels repeat or the own id is among them
        near = np.flatnonzero(sims >= np.partition(sims, len(sims) - want)[len(sims) - want])
        best, seen = [], set()
        for j in sorted(near.tolist(), key=lambda j: (-sims[j], ids[j])):
            if not (others and ids[j] == own) and (not label or labels[j] not in seen):
                seen.add(labels[j])
                best.append((own, ids[j], labels[j], float(sims[j])))
        if len(best) >= k or want == len(sims):
            return best[:k]
        want = min(len(sims), 4 * want)


def _unit(column: pa.ListArray, dim: int) -> np.ndarray:
    x = column.flatten().to_numpy().reshape(-1, dim)
    return x / np.sqrt((x * x).sum(axis=1))[:, None]


class Search:
    """What the steps of a search share: types, pivots by dimension, and how results are taken."""

    #: Queries for each copy of a chunk.
    share = 1 << 16

    def __init__(self, queries: DataFrame, base: DataFrame, k: int, digits: int, others: bool, label: bool, floor: float = -2.0):
        self.k, self.digits, self.others, self.label, self.floor = k, digits, others, label, floor
        self.query_kind, self.base_kind = dict(queries.dtypes)["id"], dict(base.dtypes)["id"]
        of = lambda df: to_arrow_type(df.schema["id"].dataType)
        self.found = pa.schema([("query_id", of(queries)), ("base_id", of(base)), ("label", pa.string()), ("sim", pa.float64())])
        self.row = pa.schema([("chunk", pa.int64()), ("kind", pa.int32()), ("dim", pa.int32()), ("asked", pa.list_(of(queries))), ("ids", pa.list_(of(base))), ("labels", pa.list_(pa.string())), ("vectors", pa.binary()), ("rings", pa.binary())])
        self.row_fields = f"chunk long, kind int, dim int, asked array<{self.query_kind}>, ids array<{self.base_kind}>, labels array<string>, vectors binary, rings binary"
        self.found_fields = f"query_id {self.query_kind}, base_id {self.base_kind}, label string, sim double"

    def meet(self, asked: list, x: np.ndarray, ids: list, labels: list, y: np.ndarray) -> list[tuple]:
        out: list[tuple] = []
        slack = 10.0**-self.digits  # rows that round to the same cosine count
        if self.k == 1 and not self.others:  # only rows beside the greatest cosine can be the best one
            for at in range(0, len(x), 256):
                sims = x[at : at + 256] @ y.T
                most = sims.max(axis=1, initial=-2.0)
                for i in np.flatnonzero(most >= self.floor - slack).tolist():
                    near = np.flatnonzero(sims[i] >= most[i] - slack)
                    out += top_rows(asked[at + i], np.round(sims[i, near], self.digits), [ids[j] for j in near], [labels[j] for j in near], 1, False, self.label)
            return out
        for at in range(0, len(x), 256):
            for own, s in zip(asked[at : at + 256], np.round(x[at : at + 256] @ y.T, self.digits), strict=True):
                out += top_rows(own, s, ids, labels, self.k, self.others, self.label)
        return out

    def table(self, rows: list[tuple]) -> pa.Table:
        return pa.table([pa.array(c, f.type) for c, f in zip(list(zip(*rows, strict=True)) or [()] * 4, self.found, strict=True)], schema=self.found)

    # --- a base of one chunk ------------------------------------------------------------------------------------------

    def every_pair(self, q: DataFrame, b: DataFrame, blocks: int) -> DataFrame:
        """The whole base, which is one chunk, with each block of queries."""

        def product(asked: pa.Table, rows: pa.Table) -> pa.Table:
            out: list[tuple] = []
            sizes = lambda t, c: np.diff(t.column(c).combine_chunks().offsets.to_numpy())
            for dim in np.intersect1d(sizes(asked, "v"), sizes(rows, "base_v")).tolist():
                t, u = asked.filter(pa.array(sizes(asked, "v") == dim)), rows.filter(pa.array(sizes(rows, "base_v") == dim))
                x, y = _unit(t.column("v").combine_chunks(), dim), _unit(u.column("base_v").combine_chunks(), dim)
                out += self.meet(t.column("id").to_pylist(), x, u.column("base_id").to_pylist(), u.column("label").to_pylist(), y)
            return self.table(out)

        left = q.withColumn("_q", F.pmod(F.xxhash64("id"), F.lit(blocks)))
        right = b.select(F.col("id").alias("base_id"), F.col("v").alias("base_v"), "label", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("_d"))
        return left.groupBy("_q").cogroup(right.groupBy("_d")).applyInArrow(product, self.found_fields)

    # --- many chunks --------------------------------------------------------------------------------------------------

    def chunks(self, b: DataFrame, pivots: dict[int, np.ndarray], parts: int, chunk: int) -> DataFrame:
        def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                dims = np.diff(batch.column(1).offsets.to_numpy())
                for dim in np.unique(dims).tolist():
                    t = batch.filter(pa.array(dims == dim))
                    x = _unit(t.column(1), dim)
                    p, d = np.full(len(x), -1), np.zeros(len(x))
                    if dim in pivots:
                        away = apart(x, pivots[dim])
                        p, d = away.argmin(axis=1), away.min(axis=1)
                    yield pa.RecordBatch.from_arrays([t.column(0), t.column(1), t.column(2), pa.array(np.full(len(x), dim), pa.int32()), pa.array(p, pa.int32()), pa.array(d)], ["id", "v", "label", "dim", "p", "d"])

        def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            name, held = TaskContext.get().partitionId() << 24, []
            for batch in batches:
                for r in zip(*(batch.column(c).to_pylist() for c in ("dim", "id", "label", "p", "d")), _vectors(batch.column(1)), strict=True):
                    if held and (len(held) >= chunk or held[0][0] != r[0]):
                        yield self.pack(name, held)
                        name, held = name + 1, []
                    held.append(r)
            if held:
                yield self.pack(name, held)

        rows = b.mapInArrow(placed, f"id {self.base_kind}, v array<double>, label string, dim int, p int, d double")
        return cut(rows.repartitionByRange(parts, "dim", "p", "d", F.xxhash64("id")).sortWithinPartitions("dim", "p", "d").mapInArrow(packed, self.row_fields))

    def pack(self, name: int, rows: list[tuple]) -> pa.RecordBatch:
        rings: dict[int, list[float]] = {}
        for _, _, _, p, d, _ in rows:
            r = rings.setdefault(p, [d, d])
            r[0], r[1] = min(r[0], d), max(r[1], d)
        v = np.array([r[5] for r in rows])
        v /= np.sqrt((v * v).sum(axis=1))[:, None]
        one = {"chunk": name, "kind": 0, "dim": rows[0][0], "ids": [r[1] for r in rows], "labels": [r[2] for r in rows], "vectors": v.tobytes(), "rings": np.array([(p, *r) for p, r in rings.items()]).tobytes()}
        return pa.RecordBatch.from_pylist([one], self.row)

    def route(self, q: DataFrame, directory, pivots: dict[int, np.ndarray], first: bool) -> DataFrame:
        """Queries (id, v, low) by the chunks that they go to: first the nearest one, then all others that low leaves open."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for start in range(0, whole.num_rows, 512):
                    batch = whole.slice(start, 512)
                    dims = np.diff(batch.column(1).offsets.to_numpy())
                    for dim in np.unique(dims).tolist():
                        if dim not in directory.value:
                            continue
                        names, edges, rings = directory.value[dim]
                        t = batch.filter(pa.array(dims == dim))
                        x = _unit(t.column(1), dim)
                        least = np.zeros((len(x), len(rings)))
                        if dim in pivots:
                            d = apart(x, pivots[dim])[:, rings[:, 0].astype(int)]
                            least = np.maximum(np.maximum(d - rings[:, 2], rings[:, 1] - d), 0)
                        least = np.minimum.reduceat(least, edges, axis=1)
                        near = least.argmin(axis=1)
                        if first:
                            goes = near[:, None] == np.arange(len(names))
                        else:
                            low = np.maximum(t.column(2).fill_null(-2.0).to_numpy(), self.floor) - 10.0**-self.digits  # rows that round to the same cosine count
                            goes = (least <= (np.sqrt(np.maximum(2 - 2 * low, 0)) + SLACK)[:, None]) & (near[:, None] != np.arange(len(names)))
                        ids = t.column(0).to_pylist()
                        for c in np.flatnonzero(goes.any(axis=0)).tolist():
                            at = np.flatnonzero(goes[:, c])
                            yield pa.RecordBatch.from_pylist([{"chunk": int(names[c]), "kind": 1, "dim": dim, "asked": [ids[i] for i in at], "vectors": x[at].tobytes()}], self.row)

        return cut(q.select("id", "v", "low").mapInArrow(run, self.row_fields))

    def visit(self, chunks: DataFrame, sent: DataFrame, count=None) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids: list = []
            labels: list = []
            y, name = np.zeros((0, 1)), None
            for batch in batches:
                for i in range(batch.num_rows):
                    r = batch.slice(i, 1).to_pylist()[0]
                    v = np.frombuffer(r["vectors"]).reshape(-1, r["dim"])
                    if r["kind"] == 0:
                        ids, labels, y, name = r["ids"], r["labels"], v, r["chunk"]
                        continue
                    if name != r["chunk"]:
                        raise ValueError("a query without its chunk")
                    if count is not None:
                        count.add(len(v) * len(y))
                    yield from self.table(self.meet(r["asked"], v, ids, labels, y)).to_batches()

        # A chunk that many queries go to is there several times, so that more tasks take them than there are chunks.
        copies = F.broadcast(sent.groupBy("chunk").agg(F.ceil(F.sum(F.size("asked")) / self.share).cast("int").alias("copies")))
        there = chunks.join(copies, "chunk").select(*chunks.columns, F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("copy"))
        dealt = sent.join(copies, "chunk").select(*sent.columns, F.pmod(F.xxhash64("asked"), F.col("copies")).cast("int").alias("copy"))
        return cut(there.unionByName(dealt).repartition("chunk", "copy").sortWithinPartitions("chunk", "copy", "kind").mapInArrow(run, self.found_fields))

    def pruned(self, q: DataFrame, b: DataFrame, rows: int, chunk: int, max_chunks: int, sample: int, count) -> DataFrame:
        spark = b.sparkSession
        chunk = max(chunk, -(-rows // max_chunks))
        some: dict[int, list] = {}
        for r in b.select("id", "v").orderBy(F.xxhash64("id"), F.xxhash64("v")).limit(sample).collect():
            some.setdefault(len(r["v"]), []).append(r["v"])
        pivots = {dim: np.unique(x / np.sqrt((x * x).sum(axis=1))[:, None], axis=0) for dim, x in ((d, np.array(v, float)) for d, v in some.items())}
        chunks = self.chunks(b, pivots, -(-rows // chunk), chunk)
        by_dim: dict[int, list] = {}
        for r in chunks.select("chunk", "dim", "rings").orderBy("chunk").collect():  # max_chunks rows, a few rings each
            by_dim.setdefault(r["dim"], []).append((r["chunk"], np.frombuffer(r["rings"]).reshape(-1, 3)))
        directory = spark.sparkContext.broadcast({dim: (np.array([c for c, _ in x]), np.cumsum([0, *(len(r) for _, r in x)])[:-1], np.concatenate([r for _, r in x])) for dim, x in by_dim.items()})
        q = cut(q.select("id", "v"))
        first = self.visit(chunks, self.route(q.withColumn("low", F.lit(None).cast("double")), directory, pivots, True), count)
        low = first.groupBy("query_id").agg(F.when(F.count("*") == self.k, F.min("sim")).alias("low"))
        rest = self.visit(chunks, self.route(q.join(low, q["id"] == low["query_id"], "left").select("id", "v", "low"), directory, pivots, False), count)
        return first.unionByName(rest)


def _vectors(column: pa.ListArray) -> Iterator[np.ndarray]:
    flat, ends = column.flatten().to_numpy(), np.cumsum(np.diff(column.offsets.to_numpy()))
    return (flat[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)) if len(ends) else iter(())


def apart(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(2 - 2 * x @ y.T, 0))


def nearest_vectors(
    queries: DataFrame, base: DataFrame, k: int, block: int = 2048, chunk: int = 8192, digits: int = 6, others: bool = False, label: str | None = None, max_chunks: int = 65_536, pivots: int = 128, count=None, floor: float = -2.0
) -> DataFrame:
    """(query_id, base_id, sim, rank): the k nearest vectors by cosine. Frames: id, v.

    others leaves a query's own id out. With label (a column of base) only the best row of each label counts, and is returned with
    it. Ties go to the smaller id. Vectors that are null or zero, and rows of another dimension than the query's, take no part.

    A base of up to `chunk` rows meets the queries as it is; a larger one is cut into chunks, of which bounds leave out what they can.
    `pivots` rows of the least hash are the pivots, a bounded sample; the directory of chunks is broadcast, so chunks grow where
    there would be more than `max_chunks`. count, an accumulator, gets the number of products in the second case. Rows below the cosine
    `floor` may be missing: a caller that has no use for them lets bounds leave out more.
    """
    lab = F.col(label).cast("string") if label else F.lit(None).cast("string")
    fine = lambda df, *more: df.select("id", F.col("v").cast("array<double>").alias("v"), *more).where("v IS NOT NULL AND exists(v, x -> x <> 0) AND forall(v, x -> x IS NOT NULL)")
    q, b = fine(queries), fine(base, lab.alias("label"))
    search, rows = Search(queries, base, k, digits, others, bool(label), floor), b.count()
    met = search.every_pair(q, b, max(1, -(-q.count() // block))) if rows <= chunk else search.pruned(q, b, rows, chunk, max_chunks, pivots, count)
    if label:
        one = Window.partitionBy("query_id", "label").orderBy(F.desc("sim"), "base_id")
        met = met.withColumn("_k", F.row_number().over(one)).where("_k = 1").drop("_k")
    w = Window.partitionBy("query_id").orderBy(F.desc("sim"), "base_id")
    out = met.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return out if label else out.drop("label")
