"""Similar sets counted tile by tile: exact, and no pair leaves its task.

Sets are put in order of size and packed into chunks, each with a dictionary of its own. Two chunks whose sizes allow a similar pair are
a tile. A tile looks at its pairs by size, then by bitmaps of 512 parities, which differ in no more bits than the sets in grams; what is
left is counted in full, by bit rows over the grams that both chunks have. Only sums for each set leave a tile. So the shuffle carries
sets, once for each chunk that theirs meets, and its volume doesn't depend on how many pairs are similar. It grows with the square of the
chunks all the same, so tiles are done in waves, each of which carries about twice the chunks at most and deletes its shuffle at its end.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.sources.scratch import cut, fresh, tidy

#: 64-bit words of a set's bitmap.
BITMAP = 8
#: Grams whose bit rows a tile holds at a time.
SLICE = 1 << 15
#: Bytes that a wave of tiles may carry in any case, and partners of a chunk in one task.
WAVE, PARTNERS = 1 << 28, 8


def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The last column, lists of grams of up to three characters, as size and bytes: their code points as numbers, in order, by differences."""
    for batch in batches:
        lists = batch.columns[-1]
        chars = np.array(lists.flatten().to_pylist() or [""], "U3").view(np.uint32).reshape(-1, 3).astype(np.int64)
        codes = chars[:, 0] << 42 | chars[:, 1] << 21 | chars[:, 2]
        sizes = np.array([len(x) if x.is_valid else 0 for x in lists], np.int64)
        ends = np.cumsum(sizes)
        data = [zlib.compress(np.diff(np.sort(codes[a:b]), prepend=0).tobytes(), 1) for a, b in zip(ends - sizes, ends, strict=True)]
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(sizes), pa.array(data, pa.binary())], [*batch.schema.names[:-1], "size", "data"])


def _codes(data: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(zlib.decompress(data), np.int64))


class Chunk:
    """Sets in order of size: ids, numbers, sizes, bitmaps, and grams as places in a dictionary."""

    def __init__(self, ids: list, numbers: list, sizes: list, words: bytes, places: bytes):
        self.ids, self.numbers, self.sizes = ids, np.array(numbers, np.int64), np.array(sizes, np.int64)
        self.words = _codes(words)
        self.places = np.frombuffer(zlib.decompress(places), np.int32)
        self.ends = np.cumsum(self.sizes)
        bit = (self.words.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - 9)).astype(np.int64)
        self.bits = np.empty((len(ids), BITMAP), np.uint64)
        for k, (a, b) in enumerate(zip(self.ends - self.sizes, self.ends, strict=True)):
            odd = (np.bincount(bit[self.places[a:b]], minlength=64 * BITMAP) & 1).astype(np.uint8)
            self.bits[k] = np.packbits(odd).view(np.uint64)

    def rows(self, words: np.ndarray) -> np.ndarray:
        """Bit rows over some of the grams."""
        at = np.searchsorted(words, self.words)
        at[at == len(words)] = 0
        column = np.where(words[at] == self.words, at, -1)[self.places] if len(words) else np.full(len(self.places), -1)
        out = np.zeros((len(self.ids), -(-len(words) // 64)), np.uint64)
        for k in range(0, len(self.ids), 256):
            end = min(k + 256, len(self.ids))
            a, b = (self.ends[k - 1] if k else 0), self.ends[end - 1]
            row, col = np.repeat(np.arange(end - k), self.sizes[k:end]), column[a:b]
            flags = np.zeros((end - k, out.shape[1] * 64), bool)
            flags[row[col >= 0], col[col >= 0]] = True
            out[k:end] = np.packbits(flags, axis=1).view(np.uint64)
        return out


def candidates(theta: float, a: Chunk, b: Chunk, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Pairs that sizes and bitmaps leave, among them all similar ones."""
    left: list[np.ndarray] = []
    right: list[np.ndarray] = []
    for k in range(0, len(a.ids), 128):
        x = a.sizes[k : k + 128]
        lo, hi = np.searchsorted(b.sizes, theta * x[0] - 1e-9, "left"), np.searchsorted(b.sizes, x[-1] / theta + 1e-9, "right")
        if lo == hi:
            continue
        both = x[:, None] + b.sizes[lo:hi]
        apart = np.zeros(both.shape, np.uint16)
        for w in range(BITMAP):
            apart += np.bitwise_count(a.bits[k : k + 128, w, None] ^ b.bits[lo:hi, w])
        ok = apart <= both - 2 * np.ceil(theta / (1 + theta) * both - 1e-9)
        if same:
            ok &= np.arange(k, k + len(x))[:, None] < np.arange(lo, hi)
        i, j = np.nonzero(ok)
        left.append((i + k).astype(np.int32))
        right.append((j + lo).astype(np.int32))
    none = np.zeros(0, np.int32)
    return np.concatenate([none, *left]), np.concatenate([none, *right])


def tile(theta: float, a: Chunk, b: Chunk, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """For each set of both chunks the summed numbers of the similar sets in the other one; same: one chunk with itself."""
    i, j = candidates(theta, a, b, same)
    of_a, of_b = np.zeros(len(a.ids), np.int64), np.zeros(len(b.ids), np.int64)
    if len(i):
        words, shared = np.intersect1d(a.words, b.words, assume_unique=True), np.zeros(len(i), np.int32)
        for s in range(0, len(words), SLICE):
            x = a.rows(words[s : s + SLICE])
            y = x if same else b.rows(words[s : s + SLICE])
            for k in range(0, len(i), 2048):
                shared[k : k + 2048] += np.bitwise_count(x[i[k : k + 2048]] & y[j[k : k + 2048]]).sum(axis=1, dtype=np.int32)
        good = shared / (a.sizes[i] + b.sizes[j] - shared) >= theta
        np.add.at(of_a, i[good], b.numbers[j[good]])
        np.add.at(of_a if same else of_b, j[good], a.numbers[i[good]])
    return of_a, of_b


_CHUNK = pa.schema([("chunk", pa.int64()), ("low", pa.int64()), ("high", pa.int64()), ("ids", pa.list_(pa.string())), ("numbers", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int64())), ("words", pa.binary()), ("places", pa.binary())])


def _packed(most: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    name, held, grams = TaskContext.get().partitionId() << 24, [], 0

    def pack() -> pa.RecordBatch:
        words, places = np.unique(np.concatenate([_codes(r[3]) for r in held]), return_inverse=True)
        one = {"chunk": name, "low": held[0][2], "high": held[-1][2], "ids": [r[0] for r in held], "numbers": [r[1] for r in held], "sizes": [r[2] for r in held]}
        one |= {"words": zlib.compress(np.diff(words, prepend=0).tobytes(), 1), "places": zlib.compress(places.astype(np.int32).tobytes(), 1)}
        return pa.RecordBatch.from_pylist([one], _CHUNK)

    for batch in batches:
        for r in zip(*(batch.column(c).to_pylist() for c in ("class_id", "n", "size", "data")), strict=True):
            if held and (len(held) >= most or grams + r[2] > 1024 * most):
                yield pack()
                name, held, grams = name + 1, [], 0
            held.append(r)
            grams += r[2]
    if held:
        yield pack()


def _met(theta: float, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    own, name = None, None
    for batch in batches:
        for k in range(batch.num_rows):
            r = batch.slice(k, 1).to_pylist()[0]
            one = Chunk(r["ids"], r["numbers"], r["sizes"], r["words"], r["places"])
            if r["chunk"] == r["other"]:  # comes before its partners
                own, name = one, (r["chunk"], r["part"])
                if r["part"]:
                    continue
            elif name != (r["chunk"], r["part"]):
                raise ValueError("a partner without its chunk")
            sums = [(own, tile(theta, own, own, True)[0])] if one is own else list(zip((own, one), tile(theta, own, one, False), strict=True))
            for c, m in sums:
                at = np.flatnonzero(m)
                if len(at):
                    yield pa.RecordBatch.from_arrays([pa.array([c.ids[i] for i in at.tolist()], pa.string()), pa.array(m[at])], ["class_id", "m"])


def similar_counts(sets: DataFrame, theta: float, chunk: int = 8192) -> DataFrame:
    """(class_id, m): the summed n of the other sets that reach theta, for each set of (class_id, n, size, data) that has such.

    data is what encoded() gives. A chunk holds up to `chunk` sets and 1,024 times as many grams, fewer where there are few sets, so that
    tiles are many. Each chunk is sent to those whose sizes it may meet; which these are, is a join of their names and sizes. The driver
    gets counts only.
    """
    spark, rows = sets.sparkSession, sets.count()
    most = min(chunk, max(256, -(-rows // 32)))
    fields = "chunk long, low long, high long, ids array<string>, numbers array<long>, sizes array<long>, words binary, places binary"
    with tidy(spark):
        dealt = sets.repartitionByRange(max(1, -(-rows // (2 * most))), "size", "class_id").sortWithinPartitions("size", "class_id")
        chunks = cut(dealt.mapInArrow(lambda it: _packed(most, it), fields))
    names = cut(chunks.select("chunk", "low", "high", (F.octet_length("words") + F.octet_length("places") + 56 * F.size("ids")).cast("long").alias("bytes")))
    to = names.select(F.col("chunk").alias("to"), F.col("high").alias("top"), F.col("low").alias("bottom"))
    meets = (F.col("chunk") > F.col("to")) & (F.col("low") * theta <= F.col("top") + 1e-6) & (F.col("bottom") * theta <= F.col("high") + 1e-6)
    pairs = cut(names.join(F.broadcast(to), meets).select(F.col("chunk").alias("other"), "to", "bytes"))  # a name and two sizes of each chunk
    # A chunk's partners are dealt to parts, each with the chunk itself; of its partners all have greater names, so it comes first there.
    parts = names.select(F.col("chunk").alias("to"), F.col("bytes").alias("own")).join(pairs.groupBy("to").agg(F.count("*").alias("n")), "to", "left")
    parts = cut(parts.select("to", "own", F.greatest(F.lit(1), F.ceil(F.coalesce("n", F.lit(0)) / PARTNERS)).cast("int").alias("parts")))
    held = parts.select("to", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.col("to").alias("other"), F.col("own").alias("bytes"))
    met = pairs.join(parts, "to").select("to", F.pmod(F.xxhash64("other"), F.col("parts")).cast("int").alias("part"), "other", "bytes")
    groups = cut(held.unionByName(met))
    every, whole = (df.agg(F.sum("bytes")).first()[0] or 0 for df in (groups, names))
    waves, path, tasks = max(1, -(-every // max(WAVE, 2 * whole))), fresh(spark), held.count()
    for wave in range(waves):
        with tidy(spark):
            mine = groups.where(F.pmod(F.xxhash64("to", "part"), F.lit(waves)) == wave).drop("bytes")
            sent = mine.join(chunks.withColumnRenamed("chunk", "other"), "other").select(F.col("to").alias("chunk"), "part", "other", "ids", "numbers", "sizes", "words", "places")
            sent = sent.repartition(max(1, -(-3 * tasks // waves)), "chunk", "part").sortWithinPartitions("chunk", "part", "other")
            sent.mapInArrow(lambda it: _met(theta, it), "class_id string, m long").groupBy("class_id").agg(F.sum("m").alias("m")).write.mode("append").parquet(path)
    return spark.read.schema("class_id string, m long").parquet(path).groupBy("class_id").agg(F.sum("m").alias("m"))
