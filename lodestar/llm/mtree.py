"""Exact top-k inner products through M-trees searched best-first.

Inner products become distances by one more component: with M the largest norm, a row x gets sqrt(M^2 - |x|^2) and a query 0, so
that d(q, x)^2 = |q|^2 + M^2 - 2 <q, x>, and the nearest rows have the largest products. Rows are dealt out by their nearest
routing object and distance to it (range partitions: a common vector is cut like any other run), and each part of `shard_rows`
rows becomes one tree, stored as pages of at most `page` entries: routing object, covering radius, distance to the parent's
routing object, and per leaf entry the distance to the page's own.

A search takes the pages with the least possible distance first. |d(q, parent) - d(parent, page)| - radius bounds a page without
computing any distance, and the same inequality leaves out leaf entries. What remains of a page meets all queries that ask for it
in one product, exact in integers, so scores and ties are exact.

Queries are dealt out like rows, so each first searches the tree in its own neighbourhood, in the task that builds it. Its k-th
score there is a bound for all others: the roots of all trees form a directory, and a query goes on only to trees whose root
leaves room for a score that good. Only those pairs are shuffled, as one array for each block of queries and tree.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, table

#: Pages of the trees, and (node -1) what the queries of a tree's neighbourhood found in it.
PAGES = "shard long, node int, leaf boolean, routing binary, radius double, to_parent double, children binary, ids binary, vectors binary, to_routing binary"
FOUND = "uids array<long>, vec_ids array<long>, scores array<long>, own array<boolean>"
ASKED = "qids binary, quids binary, qs binary, floors binary"
_TYPES = {"long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "binary": pa.binary(), "double": pa.float64(), "array<long>": pa.list_(pa.int64()), "array<boolean>": pa.list_(pa.bool_())}
#: No score yet. True scores outside the long range count as its ends.
NONE = np.iinfo(np.int64).min
#: Distances from products are right to this share of the norms involved; bounds give way by it, so that rounding never prunes a right answer.
SLACK = 1e-6


def _schema(fields: str) -> pa.Schema:
    return pa.schema([(n, _TYPES[t]) for n, t in (f.split() for f in fields.split(", "))])


def _batch(rows: list[dict], fields: str) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, _schema(fields))


def augmented(v: np.ndarray, norm2: float) -> np.ndarray:
    v = v.astype(np.float64)
    return np.column_stack([v, np.sqrt(np.maximum(norm2 - (v * v).sum(axis=1), 0))])


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """From one point to many."""
    return np.sqrt(((b - a) ** 2).sum(axis=1))


def between(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """From many points to many."""
    return np.sqrt(np.maximum((a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1) - 2 * a @ b.T, 0))


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer products of all rows of a and b: by doubles where all of them hold every partial sum, else by long integers."""
    x, y = a.astype(np.float64), b.astype(np.float64)
    if not len(a) or not len(b) or (x * x).sum(axis=1).max() * (y * y).sum(axis=1).max() < 2.0**104:
        return (x @ y.T).astype(np.int64)
    return np.clip(a.astype(object) @ b.astype(object).T, NONE + 1, -(NONE + 1)).astype(np.int64)


def build(ids: np.ndarray, vectors: np.ndarray, norm2: float, page: int) -> list[dict]:
    """Pages of one tree. A page that overflows is split between `page` far-apart routing objects, each row going to the nearest."""
    points = augmented(vectors, norm2)
    narrow = np.int32 if len(vectors) and np.abs(vectors.astype(np.float64)).max() < 2.0**31 else np.int64
    out: list[dict] = []

    def add(rows: np.ndarray, parent_routing: np.ndarray | None) -> int:
        node, own = len(out), points[rows]
        routing = own[np.argmin(distances(own.mean(axis=0), own))]
        away = distances(routing, own)
        to_parent = 0.0 if parent_routing is None else float(distances(parent_routing, routing[None])[0])
        out.append({"node": node, "leaf": len(rows) <= page, "routing": routing.tobytes(), "radius": float(away.max()), "to_parent": to_parent})
        if len(rows) <= page:
            out[node] |= {"ids": ids[rows].tobytes(), "vectors": vectors[rows].astype(narrow).tobytes(), "to_routing": away.tobytes()}
            return node
        fan = min(page, max(2, -(-len(rows) // page)))
        nearest, n = np.zeros(len(rows), np.int64), 1
        least = distances(own[int(np.argmax(away))], own)
        while n < fan and least.max() > 0:
            d = distances(own[int(np.argmax(least))], own)
            nearest[d < least] = n
            least = np.minimum(least, d)
            n += 1
        parts = [rows[nearest == k] for k in range(n)]
        if n == 1:  # all rows are equal
            parts = np.array_split(rows, fan)
        out[node]["children"] = np.array([add(p, routing) for p in parts if len(p)], np.int64).tobytes()
        return node

    if len(ids):
        add(np.arange(len(ids)), None)
    return out


class Queries:
    """A block of queries and the `size` best rows that they have met, best first."""

    def __init__(self, qids: np.ndarray, uids: np.ndarray, vectors: np.ndarray, floors: np.ndarray, size: int):
        self.qids, self.uids, self.vectors, self.floors = qids, uids, vectors, floors
        self.points = np.column_stack([vectors.astype(np.float64), np.zeros(len(vectors))])
        self.norm2 = (self.points * self.points).sum(axis=1)
        self.scores, self.ids = np.full((len(qids), size), NONE), np.zeros((len(qids), size), np.int64)

    def low(self, at: np.ndarray | slice = slice(None)) -> np.ndarray:
        """The least score that still counts."""
        return np.maximum(self.scores[at, -1], self.floors[at])

    def reach(self, norm2: float, at: np.ndarray | slice = slice(None)) -> np.ndarray:
        """The greatest distance at which a row could have it."""
        low = self.low(at)
        far = np.sqrt(np.maximum(self.norm2[at] + norm2 - 2 * low.astype(np.float64), 0))
        return np.where(low == NONE, np.inf, far + SLACK * (np.sqrt(self.norm2[at]) + np.sqrt(norm2)) + 1e-9)

    def meet(self, at: np.ndarray, ids: np.ndarray, scores: np.ndarray, ok: np.ndarray) -> None:
        ok &= scores >= self.low(at)[:, None]
        hit = np.flatnonzero(ok.any(axis=1))
        if len(hit):
            at = at[hit]
            s = np.hstack([self.scores[at], np.where(ok[hit], scores[hit], NONE)])
            i = np.hstack([self.ids[at], np.broadcast_to(ids, (len(at), len(ids)))])
            order = np.lexsort((i, ~s), axis=1)[:, : self.scores.shape[1]]  # ~ turns the order round without overflow
            self.scores[at], self.ids[at] = np.take_along_axis(s, order, 1), np.take_along_axis(i, order, 1)

    def found(self) -> dict:
        """One flat list; own marks rows with the query's id and its product with itself."""
        row, col = np.nonzero((self.scores != NONE) & (self.scores >= self.floors[:, None]))
        selves = np.array([products(v[None], v[None])[0, 0] for v in self.vectors], np.int64)
        ids, scores = self.ids[row, col], self.scores[row, col]
        return {"uids": self.uids[row].tolist(), "vec_ids": ids.tolist(), "scores": scores.tolist(), "own": ((ids == self.qids[row]) & (scores == selves[row])).tolist()}

    def packed(self, at: np.ndarray | slice = slice(None)) -> dict:
        return {"qids": self.qids[at].tobytes(), "quids": self.uids[at].tobytes(), "qs": self.vectors[at].tobytes(), "floors": self.low(at).tobytes()}

    @staticmethod
    def unpacked(rows: list[dict], dim: int, size: int) -> Queries:
        flat = [np.frombuffer(b"".join(r[c] for r in rows), np.int64) for c in ("qids", "quids", "qs", "floors")]
        return Queries(flat[0], flat[1], flat[2].reshape(-1, dim), flat[3], size)


class Tree:
    def __init__(self, pages: list[dict], dim: int, norm2: float):
        pages = sorted(pages, key=lambda p: p["node"])
        one = lambda p, c, t: np.frombuffer(p.get(c) or b"", t)
        self.norm2 = norm2
        self.leaf = [p["leaf"] for p in pages]
        self.routing = np.array([one(p, "routing", np.float64) for p in pages])
        self.radius, self.to_parent = np.array([p["radius"] for p in pages]), np.array([p["to_parent"] for p in pages])
        self.children, self.ids, self.to_routing = [one(p, "children", np.int64) for p in pages], [one(p, "ids", np.int64) for p in pages], [one(p, "to_routing", np.float64) for p in pages]
        width = lambda p: np.int64 if len(p.get("vectors") or b"") == 8 * dim * (len(p.get("ids") or b"") // 8) else np.int32
        self.vectors = [one(p, "vectors", width(p)).reshape(-1, dim) for p in pages]

    def search(self, q: Queries) -> None:
        """Best-first for all queries at once: in each round a query takes its nearest open pages, twice as many as before."""
        slack = SLACK * (np.sqrt(q.norm2) + np.sqrt(self.norm2))
        away = np.zeros((len(q.qids), len(self.leaf)))  # to the routing objects that were met
        least = np.full(away.shape, np.inf)  # of open pages; infinite: not met, or done
        away[:, 0] = between(q.points, self.routing[:1])[:, 0]
        least[:, 0] = np.maximum(away[:, 0] - self.radius[0] - slack, 0)
        many = 1
        while True:
            taken = least <= q.reach(self.norm2)[:, None]
            taken &= np.isfinite(least)
            if not taken.any():
                return
            if many < least.shape[1]:
                first = np.argpartition(least, many - 1, axis=1)[:, :many]
                mine = np.zeros_like(taken)
                np.put_along_axis(mine, first, True, axis=1)
                taken &= mine
            many *= 2
            for node in np.flatnonzero(taken.any(axis=0)).tolist():
                at = np.flatnonzero(taken[:, node])
                reach = q.reach(self.norm2, at)
                still = least[at, node] <= reach  # other pages of the round may have narrowed it
                least[at, node] = np.inf
                at, reach = at[still], reach[still]
                if not len(at):
                    continue
                d = away[at, node]
                if self.leaf[node]:
                    near = np.abs(d[:, None] - self.to_routing[node]) <= (reach + slack[at])[:, None]  # no distance computed yet
                    row, col = np.flatnonzero(near.any(axis=1)), np.flatnonzero(near.any(axis=0))
                    if len(row):
                        q.meet(at[row], self.ids[node][col], products(q.vectors[at[row]], self.vectors[node][col]), near[np.ix_(row, col)])
                    continue
                kids = self.children[node]
                maybe = np.abs(d[:, None] - self.to_parent[kids]) - self.radius[kids] <= (reach + slack[at])[:, None]  # nor here
                row, col = np.flatnonzero(maybe.any(axis=1)), np.flatnonzero(maybe.any(axis=0))
                if len(row):
                    cells = np.ix_(at[row], kids[col])
                    away[cells] = between(q.points[at[row]], self.routing[kids[col]])
                    bound = np.maximum(away[cells] - self.radius[kids[col]] - slack[at[row]][:, None], 0)
                    least[cells] = np.where(maybe[np.ix_(row, col)], bound, np.inf)


def index(rows: DataFrame, asked: DataFrame, norm2: float, routes: np.ndarray, dim: int, size: int, shard_rows: int, parts: int, page: int, blocks: int, block: int) -> DataFrame:
    """The pages of all trees, and per tree what the queries of its neighbourhood found there. Every row is in exactly one leaf."""
    points = augmented(routes, norm2)

    def routed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            v = b.column(1).flatten().to_numpy().reshape(-1, dim)
            p = augmented(v, max(norm2, float((v.astype(np.float64) ** 2).sum(axis=1).max())))
            d = between(p, points)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(d.argmin(axis=1)), pa.array(d.min(axis=1))], ["id", "v", "uid", "route", "away"])

    fields = f"{PAGES}, block long, {ASKED}, {FOUND}"

    def trees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, made = TaskContext.get().partitionId(), 0
        held: list[tuple] = []

        def flush() -> pa.RecordBatch:
            nonlocal made
            i, v, u = (np.concatenate([h[k] for h in held]) for k in range(3))
            held.clear()
            name, query = (part << 24) + made, u >= 0
            made += 1
            out = [p | {"shard": name} for p in build(i[~query], v[~query], norm2, page)]
            tree = Tree(out, dim, norm2) if out else None
            for k in range(0, int(query.sum()), block):
                at = np.flatnonzero(query)[k : k + block]
                q = Queries(i[at], u[at], v[at], np.full(len(at), NONE), size)
                if tree:
                    tree.search(q)
                # Neighbouring trees share a block, as their queries ask for the same trees.
                out.append({"shard": name, "node": -1, "block": ((part * blocks // parts) << 24) + k // block} | q.packed() | q.found())
            return _batch(out, fields)

        n = 0
        for b in batches:
            for k in range(0, b.num_rows, shard_rows):
                x = b.slice(k, shard_rows)
                uids = x.column(2).fill_null(-1).to_numpy(zero_copy_only=False)
                held.append((x.column(0).to_numpy(), x.column(1).flatten().to_numpy().reshape(-1, dim), uids))
                n += int((uids < 0).sum())
                if n >= shard_rows:
                    yield flush()
                    n = 0
        if held:
            yield flush()

    both = rows.select("id", "v", F.lit(None).cast("long").alias("uid")).unionByName(asked.select("id", "v", "uid"))
    dealt = both.mapInArrow(routed, "id long, v array<long>, uid long, route long, away double").repartitionByRange(parts, "route", "away", "id")
    return cut(dealt.mapInArrow(trees, fields))


def top_k(rows: DataFrame, queries: DataFrame, k: int = 5, shard_rows: int = 4096, page: int = 64, block: int = 2048, sample: int = 128, max_trees: int = 65_536) -> DataFrame:
    """query_id, rank, vec_id, score: for each query (id, v) its k best rows (id, v) by inner product but its own row.

    v is array<long>; vectors of another than the most common length (of equally common ones the longest) take no part, on either
    side. Ties go to the smaller id. A query with fewer than k other rows gets all of them; no rows or no queries give no result.
    Ids may repeat: of the rows with the query's id and its product with itself one counts as its own, its twins are candidates,
    and a query that is there twice is answered twice, with ranks of its own. Null ids and null vectors take no part. Other columns
    of either frame are ignored. Scores outside the long range count as its ends.

    `sample` rows of the least hash serve as routing objects. The directory of roots is broadcast: trees grow beyond `shard_rows`
    so that there are about `max_trees` at most, at 8 (length + 1) bytes each.
    """
    spark, kind = rows.sparkSession, "query_id long, rank int, vec_id long, score long"
    norm = lambda: F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    whole = F.col("id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0)
    rows, queries = rows.select("id", "v").where(whole), queries.select("id", "v").where(whole)
    lengths = rows.groupBy(F.size("v").alias("dim")).agg(F.count("*").alias("n"), F.max(norm()).alias("norm2"))
    top = lengths.orderBy(F.desc("n"), F.desc("dim")).first()
    if top is None:
        return spark.createDataFrame([], kind)
    dim, norm2, of_length = top["dim"], top["norm2"], F.size("v") == top["dim"]
    rows = rows.where(of_length)
    asked = cut(queries.where(of_length).groupBy("id", "v").agg(F.count("*").alias("times")).withColumn("uid", F.monotonically_increasing_id()))
    n_asked = asked.count()
    if not n_asked:
        return spark.createDataFrame([], kind)
    routes = np.array([r["v"] for r in rows.orderBy(F.xxhash64("id"), "id").limit(sample).collect()], np.int64)
    shard_rows = max(shard_rows, -(-top["n"] // max_trees))
    parts, blocks, size = max(1, -(-top["n"] // shard_rows)), max(1, -(-n_asked // block)), k + 1  # one more for the query's own row
    made = index(rows, asked, norm2, routes, dim, size, shard_rows, parts, page, blocks, block)
    pages, home = made.where("node >= 0").select(*[f.split()[0] for f in PAGES.split(", ")]), made.where("node < 0")
    roots = pages.where("node = 0").select("shard", "routing", "radius").orderBy("shard").collect()
    directory = spark.sparkContext.broadcast((np.array([r["shard"] for r in roots], np.int64), np.array([np.frombuffer(r["routing"]) for r in roots]), np.array([r["radius"] for r in roots])))

    def onward(group: pa.Table) -> pa.Table:
        """For each tree the queries of a block that its root doesn't rule out."""
        shards, routing, radius = directory.value
        rows_, out = group.to_pylist(), []
        q = Queries.unpacked(rows_, dim, size)
        own = np.repeat([r["shard"] for r in rows_], [len(r["quids"]) // 8 for r in rows_])
        reach = q.reach(norm2) + SLACK * (np.sqrt(q.norm2) + np.sqrt(norm2))
        for j in range(0, len(shards), 1024):
            open_ = (between(q.points, routing[j : j + 1024]) - radius[j : j + 1024] <= reach[:, None]) & (own[:, None] != shards[j : j + 1024])
            for t in np.flatnonzero(open_.any(axis=0)).tolist():
                out.append({"shard": int(shards[j + t]), "block": rows_[0]["block"]} | q.packed(np.flatnonzero(open_[:, t])))
        return pa.Table.from_batches([_batch(out, f"shard long, block long, {ASKED}")])

    def met(left: pa.Table, right: pa.Table) -> pa.Table:
        tree, out = Tree(right.to_pylist(), dim, norm2), []
        for row in left.to_pylist():
            q = Queries.unpacked([row], dim, size)
            tree.search(q)
            out.append(q.found())
        return pa.Table.from_batches([_batch(out, FOUND)])

    pairs = cut(home.select("shard", "block", *[f.split()[0] for f in ASKED.split(", ")]).groupBy("block").applyInArrow(onward, f"shard long, block long, {ASKED}"))
    sent = pages.join(pairs.select(F.col("shard").alias("to_shard"), F.col("block").alias("to_block")), F.col("shard") == F.col("to_shard"))
    others = pairs.groupBy("shard", "block").cogroup(sent.groupBy("to_shard", "to_block")).applyInArrow(met, FOUND)
    names = [f.split()[0] for f in FOUND.split(", ")]
    found = home.select(*names).unionByName(others).select(F.inline(F.arrays_zip(*names))).select(F.col("uids").alias("uid"), F.col("vec_ids").alias("vec_id"), F.col("scores").alias("score"), "own")
    best, mine = Window.partitionBy("uid").orderBy(F.desc("score"), "vec_id"), Window.partitionBy("uid")
    ranked = found.withColumn("r", F.row_number().over(best)).where(F.col("r") <= size).withColumn("o", F.min(F.when(F.col("own"), F.col("r"))).over(mine))
    ranked = ranked.where("o IS NULL OR r <> o").withColumn("rank", F.col("r") - F.coalesce(F.col("r") > F.col("o"), F.lit(False)).cast("int")).where(F.col("rank") <= k)
    out = ranked.join(asked.select("uid", F.col("id").alias("query_id"), "times"), "uid").withColumn("_t", F.explode(F.sequence(F.lit(1), F.col("times").cast("int"))))
    return out.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def integers(embeddings: DataFrame, *carry: str) -> DataFrame:
    """(id, v) of the vectors without null or non-finite components, and columns to carry; each component is floor(256 x), at most
    9.2e18 away from 0."""
    x = F.col("embedding").cast("array<double>")
    fine = x.isNotNull() & F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < F.lit(float("inf"))))
    rows = embeddings.where(F.col("vec_id").isNotNull()).select("vec_id", x.alias("embedding"), *carry).where(fine & (F.size("embedding") > 0))
    whole = lambda e: F.floor(F.greatest(F.least(e * 256, F.lit(9.2e18)), F.lit(-9.2e18)))
    return rows.select(F.col("vec_id").alias("id"), F.transform("embedding", whole).cast("array<long>").alias("v"), *carry)


def op2_mtree(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = integers(table(spark, sf_dir, "embeddings"))
    return top_k(rows, rows.where("id % 50 = 0"))


SQL = """
WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 256) AS BIGINT)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
  AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT q.vec_id AS query_id, e.vec_id, CAST(list_inner_product(CAST(q.v AS DOUBLE[]), CAST(e.v AS DOUBLE[])) AS BIGINT) AS score
  FROM e q JOIN e ON e.vec_id <> q.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank FROM p)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
