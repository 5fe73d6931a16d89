"""Hard negatives by exact window search in inverted multi-indexes.

Vectors are cut in two halves, and each half has a codebook of its own; a pair of codewords is a cell. For a query q, a row x of cell
(i, j) has <q, x> <= a_i + b_j, where a_i = <q1, c_i> + |q1| r_i with the codeword c_i and the radius r_i of the first halves that it
stands for, and b_j likewise. With both lists sorted, a heap visits the pairs in falling order of the sum (multi-sequence search): it
begins with the best of both and adds the two neighbours of each pair that it takes.

A search asks for windows: of the rows whose score lies between two bounds, the `k` best. Cells are read until the next sum is under
what each window still needs, its k-th score so far or its lower end: then no other row can belong to it, and the window is certified.
Cells whose least possible score is above all windows are passed over unread.

Rows are dealt out by cell, in range partitions, so that a common cell is cut like any other run, and each `shard_rows` of them become
one shard, an index of its own with its own radii. A query first searches the shard with the greatest bound; the scores found there are
floors for the rest, and it goes on only to shards whose bound reaches them. Shards and the queries that ask for them meet in one sorted
stream for each partition: a task holds one shard and one block of queries at a time, however many there are.

The codebooks are fitted on a bounded sample. They only decide in which order rows are read, never which are found.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import bounded_batches, cut, table
from .mtree import NONE, SLACK, integers, products

MOST = np.iinfo(np.int64).max
ROW = "shard long, kind int, ids binary, labels binary, vectors binary, extra binary, reach binary"
FOUND = "uid long, w int, vec_id long, score long, own boolean"
_ROW = pa.schema([("shard", pa.int64()), ("kind", pa.int32()), ("ids", pa.binary()), ("labels", pa.binary()), ("vectors", pa.binary()), ("extra", pa.binary()), ("reach", pa.binary())])
_FOUND = pa.schema([("uid", pa.int64()), ("w", pa.int32()), ("vec_id", pa.int64()), ("score", pa.int64()), ("own", pa.bool_())])


def codebook(points: np.ndarray, codes: int, turns: int = 8) -> np.ndarray:
    """k-means from far-apart first points; the same points give the same codebook."""
    if not len(points):
        return np.zeros((1, points.shape[1]))
    centres = [points[0]]
    least = ((points - centres[0]) ** 2).sum(axis=1)
    while len(centres) < codes and least.max() > 0:
        centres.append(points[int(least.argmax())])
        least = np.minimum(least, ((points - centres[-1]) ** 2).sum(axis=1))
    book = np.array(centres)
    for _ in range(turns):
        at = nearest(points, book)
        n = np.bincount(at, minlength=len(book))
        sums = np.array([np.bincount(at, p, len(book)) for p in points.T]).T.reshape(len(book), points.shape[1])
        book = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], book)
    return book


def nearest(points: np.ndarray, book: np.ndarray) -> np.ndarray:
    return ((book * book).sum(axis=1) - 2 * points @ book.T).argmin(axis=1)


def halves(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    cut_at = v.shape[1] // 2
    return v[:, :cut_at], v[:, cut_at:]


def radii(v: np.ndarray, codes: np.ndarray, books: tuple) -> np.ndarray:
    """Per half and codeword the farthest that a row is from it, -1 where no row has it."""
    out = np.full((2, max(map(len, books))), -1.0)
    for h, part in enumerate(halves(v.astype(np.float64))):
        np.maximum.at(out[h], codes[h], np.sqrt(((part - books[h][codes[h]]) ** 2).sum(axis=1)))
    return out


class Shard:
    """Rows in order of their cells."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray, codes: np.ndarray, reach: np.ndarray, books: tuple):
        self.ids, self.labels, self.vectors, self.books, self.reach = ids, labels, vectors, books, reach
        cell = codes[0].astype(np.int64) << 32 | codes[1]
        first = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]])) if len(cell) else np.zeros(0, np.int64)
        stops = np.append(first[1:], len(cell))
        self.cells = {(int(cell[a] >> 32), int(cell[a] & 0xFFFFFFFF)): (int(a), int(b)) for a, b in zip(first, stops, strict=True)}
        self.far = float(np.sqrt((vectors.astype(np.float64) ** 2).sum(axis=1).max())) if len(ids) else 0.0
        self.read = 0  # rows whose products were computed

    def bounds(self, q: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Per half the codewords that have rows, best first, with the greatest and least half-scores they allow."""
        out = []
        for h, part in enumerate(halves(q[None].astype(np.float64))):
            have = np.flatnonzero(self.reach[h] >= 0)
            mid, room = self.books[h][have] @ part[0], np.sqrt((part[0] ** 2).sum()) * self.reach[h][have]
            order = np.argsort(-(mid + room), kind="stable")
            out.append((have[order], (mid + room)[order], (mid - room)[order]))
        return out

    def cells_by_bound(self, q: np.ndarray) -> Iterator[tuple[float, float, int, int]]:
        """(greatest score, least score, first row, end) of the cells that have rows, by falling greatest score."""
        (one, up1, low1), (two, up2, low2) = self.bounds(q)
        if not len(one) or not len(two):
            return
        heap, seen = [(-(up1[0] + up2[0]), 0, 0)], {(0, 0)}
        while heap:
            up, i, j = heapq.heappop(heap)
            at = self.cells.get((int(one[i]), int(two[j])))
            if at:
                yield -up, low1[i] + low2[j], *at
            for a, b in ((i + 1, j), (i, j + 1)):
                if a < len(one) and b < len(two) and (a, b) not in seen:
                    seen.add((a, b))
                    heapq.heappush(heap, (-(up1[a] + up2[b]), a, b))

    def search(self, q: np.ndarray, label: int, same: bool, highs: np.ndarray, floors: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Per window the k best (scores, ids) of rows with that label, or another, whose score is in it; NONE where there is none."""
        scores, ids = np.full((len(highs), k), NONE), np.zeros((len(highs), k), np.int64)
        slack, end = SLACK * np.sqrt((q.astype(np.float64) ** 2).sum()) * self.far + 1e-9, float(MOST)
        need, top, step, held, rows = float(floors.min()), float(highs.max()), 256, [], 0

        def meet() -> None:
            nonlocal need
            at = np.concatenate([np.arange(a, b) for a, b in held])
            at = at[(self.labels[at] == label) == same]
            self.read += len(at)
            s, own = products(q[None], self.vectors[at])[0], self.ids[at]
            for w in range(len(highs)):
                low = max(floors[w], scores[w, -1])
                ok = (s <= highs[w]) & (s >= low)
                if ok.any():
                    some, names = np.concatenate([scores[w], s[ok]]), np.concatenate([ids[w], own[ok]])
                    best = np.lexsort((names, ~some))[:k]
                    scores[w], ids[w] = some[best], names[best]
            need = float(np.maximum(scores[:, -1], floors).min())

        for up, low, a, b in self.cells_by_bound(q):
            if max(up, -end) + slack < need:
                break
            if min(low, end) - slack > top:
                continue
            held.append((a, b))
            rows += b - a
            if rows >= step:
                meet()
                held, rows, step = [], 0, step * 2
        if held:
            meet()
        return scores, ids


def packed(rows: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, _ROW)


def index(rows: DataFrame, books: tuple, dim: int, parts: int, shard_rows: int) -> DataFrame:
    """The shards (kind 0); every row is in exactly one."""

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                v = b.column(1).flatten().to_numpy().reshape(-1, dim).astype(np.float64)
                codes = [pa.array(nearest(p, book), pa.int32()) for p, book in zip(halves(v), books, strict=True)]
                yield pa.RecordBatch.from_arrays([*b.columns, *codes], ["id", "v", "label", "c1", "c2"])

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        name, held, n = TaskContext.get().partitionId() << 24, [], 0

        def flush() -> pa.RecordBatch:
            nonlocal name
            ids, v, labels, c1, c2 = (np.concatenate([h[k] for h in held]) for k in range(5))
            held.clear()
            order = np.lexsort((ids, c2, c1))
            ids, v, labels, codes = ids[order], v[order], labels[order], np.array([c1[order], c2[order]], np.int32)
            narrow = np.int32 if np.abs(v.astype(np.float64)).max() < 2.0**31 else np.int64
            name += 1
            return packed([{"shard": name, "kind": 0, "ids": ids.tobytes(), "labels": labels.tobytes(), "vectors": v.astype(narrow).tobytes(), "extra": codes.tobytes(), "reach": radii(v, codes, books).tobytes()}])

        for b in batches:
            for k in range(0, b.num_rows, shard_rows):
                x = b.slice(k, shard_rows)
                held.append((x.column(0).to_numpy(), x.column(1).flatten().to_numpy().reshape(-1, dim), *(x.column(c).to_numpy() for c in (2, 3, 4))))
                n += x.num_rows
                if n >= shard_rows:
                    yield flush()
                    n = 0
        if held:
            yield flush()

    dealt = rows.select("id", "v", "label").mapInArrow(coded, "id long, v array<long>, label long, c1 int, c2 int").repartitionByRange(parts, "c1", "c2", "id", "label")
    return cut(dealt.mapInArrow(shards, ROW))


def route(asked: DataFrame, directory, books: tuple, dim: int, best_only: bool, block: int) -> DataFrame:
    """For each shard the queries that go there (kind 1): each to the shard of the greatest bound, or to all others that reach its floors.

    asked: uid, id, label, v, highs, floors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, reach, far = directory.value
        for batch in batches:
            for k in range(0, batch.num_rows, block):
                b = batch.slice(k, block)
                v = b.column(3).flatten().to_numpy().reshape(-1, dim)
                q = v.astype(np.float64)
                up = np.zeros((len(q), len(names)))
                for h, part in enumerate(halves(q)):
                    mid, size = part @ books[h].T, np.sqrt((part * part).sum(axis=1))
                    for s in range(0, len(names), 64):
                        room = reach[s : s + 64, h, : len(books[h])]
                        up[:, s : s + 64] += np.where(room >= 0, mid[:, None] + size[:, None, None] * room, -np.inf).max(axis=2)
                best = up.argmax(axis=1)
                highs, floors = b.column(4).to_pylist(), b.column(5).to_pylist()
                if best_only:
                    goes = best[:, None] == np.arange(len(names))
                else:
                    need = np.array([min(f) for f in floors], np.float64)
                    slack = SLACK * np.sqrt((q * q).sum(axis=1)) * far + 1e-9
                    goes = (np.maximum(up, -float(MOST)) + slack[:, None] >= need[:, None]) & (best[:, None] != np.arange(len(names)))
                out = []
                for s in np.flatnonzero(goes.any(axis=0)):
                    at = np.flatnonzero(goes[:, s])
                    marks = np.array([len(highs[i]) for i in at], np.int64)
                    windows = np.array([x for i in at for x in (*highs[i], *floors[i])], np.int64)
                    names_ = np.array([b.column(0).to_numpy()[at], b.column(1).to_numpy()[at]])
                    out.append({"shard": int(names[s]), "kind": 1, "ids": names_.tobytes(), "labels": b.column(2).to_numpy()[at].tobytes(), "vectors": v[at].tobytes(), "extra": np.concatenate([marks, windows]).tobytes(), "reach": b""})
                    if len(out) >= 32:
                        yield packed(out)
                        out = []
                if out:
                    yield packed(out)

    return cut(asked.select("uid", "id", "label", "v", "highs", "floors").mapInArrow(run, ROW))


def visit(shards: DataFrame, sent: DataFrame, books: tuple, dim: int, same: bool, k: int, count=None) -> DataFrame:
    """What the queries find in the shards they were sent to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, name, rows, done = None, None, [], 0

        def out() -> pa.RecordBatch:
            cols = [np.concatenate([r[c] for r in rows]) for c in range(5)] if rows else [np.zeros(0, np.int64)] * 5
            rows.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, _FOUND, strict=True)], schema=_FOUND)

        for batch in batches:
            for r in (batch.slice(i, 1).to_pylist()[0] for i in range(batch.num_rows)):
                ids, labels = np.frombuffer(r["ids"], np.int64), np.frombuffer(r["labels"], np.int64)
                if r["kind"] == 0:
                    if shard is not None and count is not None:
                        count.add(shard.read)
                    wide = np.int64 if len(r["vectors"]) == 8 * dim * len(ids) else np.int32
                    codes, reach = np.frombuffer(r["extra"], np.int32).reshape(2, -1), np.frombuffer(r["reach"]).reshape(2, -1)
                    shard, name = Shard(ids, labels, np.frombuffer(r["vectors"], wide).reshape(-1, dim), codes, reach, books), r["shard"]
                    continue
                if name != r["shard"]:
                    raise ValueError("a query without its shard")
                uids, own = ids.reshape(2, -1)
                q, extra = np.frombuffer(r["vectors"], np.int64).reshape(-1, dim), np.frombuffer(r["extra"], np.int64)
                at = len(uids)
                for i, uid in enumerate(uids):
                    n = int(extra[i])
                    highs, floors = extra[at : at + n], extra[at + n : at + 2 * n]
                    at += 2 * n
                    scores, found = shard.search(q[i], labels[i], same, highs, floors, k)
                    w, c = np.nonzero(scores != NONE)
                    if len(w):
                        self_score = products(q[i][None], q[i][None])[0, 0]
                        rows.append((np.full(len(w), uid), w, found[w, c], scores[w, c], same & (found[w, c] == own[i]) & (scores[w, c] == self_score)))
                        done += len(w)
                if done >= 50_000:
                    yield out()
                    done = 0
        if shard is not None and count is not None:
            count.add(shard.read)
        yield out()

    there = shards.join(F.broadcast(sent.select("shard").distinct()), "shard", "left_semi").select(*shards.columns)
    return cut(there.unionByName(sent).repartition(F.col("shard")).sortWithinPartitions("shard", "kind").mapInArrow(run, FOUND))


def best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("uid", "w").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("r", F.row_number().over(order)).where(F.col("r") <= k)


def hard_negatives(rows: DataFrame, anchors: DataFrame, positives: int = 5, negatives: int = 5, low: int = 80, codes: int = 16, sample: int = 4096, shard_rows: int = 8192, max_shards: int = 65_536, block: int = 256, count=None) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    rows and anchors: id, v (array<long>), label. An anchor's positives are its best rows of the same label but its own; for each, the
    `negatives` best rows of other labels with low * positive_score <= 100 * negative_score <= 100 * positive_score are returned, ties
    to the smaller id. Positives without any such row give none; a negative positive_score has an empty window.

    Rows with a null id, label or vector take no part, nor do vectors of another than the most common length (of equally common ones
    the longest). Ids may repeat: of the rows with the anchor's id, label and product with itself one counts as its own, its twins are
    candidates; an anchor that is there twice is answered twice. No rows or no anchors give no result. Other columns are ignored.
    Scores outside the long range count as its ends.

    The codebooks are fitted on the `sample` rows of the least hash. The directory of shards is broadcast: shards grow beyond
    `shard_rows` so that there are about `max_shards` at most, at 32 * codes bytes each.
    """
    spark, kind = rows.sparkSession, "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    bounded_batches(spark)
    whole = F.col("id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0) & F.col("label").isNotNull()
    plain = [F.col("id").cast("long").alias("id"), "v", F.col("label").cast("long").alias("label")]
    rows, anchors = rows.select(*plain).where(whole), anchors.select(*plain).where(whole)
    top = rows.groupBy(F.size("v").alias("dim")).count().orderBy(F.desc("count"), F.desc("dim")).first()
    if top is None:
        return spark.createDataFrame([], kind)
    dim, of_length = top["dim"], F.size("v") == top["dim"]
    rows = rows.where(of_length)
    asked = cut(anchors.where(of_length).groupBy("id", "label", "v").agg(F.count("*").alias("times")).withColumn("uid", F.monotonically_increasing_id()))
    if asked.isEmpty():
        return spark.createDataFrame([], kind)
    some = np.array([r["v"] for r in rows.select("v", "id").orderBy(F.xxhash64("id", "v"), "id").limit(sample).collect()], np.float64)
    books = tuple(codebook(p, codes) for p in halves(some))
    shard_rows = max(shard_rows, -(-top["count"] // max_shards))
    shards = index(rows, books, dim, max(1, -(-top["count"] // shard_rows)), shard_rows)
    made = shards.select("shard", "reach").orderBy("shard").collect()
    far = float(np.sqrt(rows.select(F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))).alias("m")).first()["m"]))
    directory = spark.sparkContext.broadcast((np.array([r["shard"] for r in made]), np.array([np.frombuffer(r["reach"]).reshape(2, -1) for r in made]), far))

    def searched(asked: DataFrame, same: bool, k: int) -> DataFrame:
        """asked: uid, id, label, v, highs, floors."""
        first = visit(shards, route(asked, directory, books, dim, True, block), books, dim, same, k, count)
        full = best(first, k).where(F.col("r") == k).groupBy("uid").agg(F.map_from_entries(F.collect_list(F.struct("w", "score"))).alias("full"))
        raised = F.transform("floors", lambda f, w: F.coalesce(F.element_at("full", w), f))
        again = asked.join(full, "uid", "left").withColumn("floors", F.when(F.col("full").isNull(), F.col("floors")).otherwise(raised))
        rest = visit(shards, route(again, directory, books, dim, False, block), books, dim, same, k, count)
        return cut(best(first.unionByName(rest), k))

    every = asked.withColumns({"highs": F.array(F.lit(MOST)), "floors": F.array(F.lit(int(NONE) + 1))})
    mine = searched(every, True, positives + 1).withColumn("o", F.min(F.when(F.col("own"), F.col("r"))).over(Window.partitionBy("uid"))).where("o IS NULL OR r <> o")
    mine = mine.withColumn("place", F.row_number().over(Window.partitionBy("uid").orderBy("r"))).where(F.col("place") <= positives)
    good = cut(mine.select("uid", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")).where("positive_score >= 0"))
    # The least long that is at least low / 100 of a positive score, exactly.
    least = lambda p: ((p.cast("decimal(20,0)") * low + 99).cast("decimal(25,0)") / F.lit(100).cast("decimal(3,0)"))
    highs = good.groupBy("uid").agg(F.sort_array(F.collect_set("positive_score")).alias("highs"))
    wanted = cut(asked.join(highs, "uid").withColumn("floors", F.transform("highs", lambda p: F.floor(least(p)).cast("long"))))
    near = searched(wanted, False, negatives)
    place = wanted.select("uid", F.posexplode("highs").alias("w", "positive_score"))
    out = good.join(place, ["uid", "positive_score"]).join(near.select("uid", "w", F.col("r").alias("rank"), F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score")), ["uid", "w"])
    out = out.join(asked.select("uid", F.col("id").alias("anchor_id"), F.explode(F.sequence(F.lit(1), F.col("times").cast("int")))), "uid")
    return out.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = integers(table(spark, sf_dir, "embeddings").withColumn("label", label), "label")
    return hard_negatives(rows, rows.where("id % 100 = 0"))


SQL = """
WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
  list_transform(embedding, lambda x: floor(CAST(x AS DOUBLE) * 256)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
  AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS a, e.vec_id AS b, q.label = e.label AS same, CAST(list_inner_product(q.v, e.v) AS BIGINT) AS score
  FROM e q JOIN e ON e.vec_id <> q.vec_id WHERE q.vec_id % 100 = 0),
p AS (SELECT a, b, score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, b) <= 5)
SELECT p.a AS anchor_id, p.b AS positive_id, CAST(row_number() OVER (PARTITION BY p.a, p.b ORDER BY s.score DESC, s.b) AS INT) AS rank,
  s.b AS negative_id, p.score AS positive_score, s.score AS negative_score
FROM p JOIN s ON s.a = p.a AND NOT s.same AND 80 * p.score <= 100 * s.score AND s.score <= p.score
QUALIFY row_number() OVER (PARTITION BY p.a, p.b ORDER BY s.score DESC, s.b) <= 5
"""
