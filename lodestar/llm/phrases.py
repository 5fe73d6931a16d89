"""Frequent word sequences that occur together more often than their parts suggest, found by Rabin-Karp fingerprints.

A text is read as one array of bytes. A prefix sum of byte values times powers of an odd base, modulo 2^64, gives the fingerprint of
every word in one subtraction and one product with an inverse power; a second prefix sum, over the words' fingerprints, gives that of
every n-gram of words inside a piece. Nothing is done word by word.

1. Counters. Every n-gram of one to five words adds to one of the counters: one for each 16 bytes of the corpus, 2^30 at most. A counter that stays under the least count rules out all n-grams that share it. What tasks send are counters capped at that
   count, of which sums are still right below it, compressed, in chunks; what returns is one bit for each counter (128 MB at most).
2. Fingerprints. The texts are read again. An n-gram goes on only if its own bit and those of all n-grams inside it are set. Tasks
   count these by fingerprint, with a pointer to an occurrence (digest of the text, first byte, length), and send sorted blocks that
   are added up by ranges of fingerprints. Phrases of one fingerprint are told apart by a second, unlike hash.
3. Verification. Only what reaches the least count is followed to the text. Each phrase that a pointer gives is hashed again and must
   give both hashes that led to it.
4. Scores, the containment rule and ranks are joins and aggregates over the frequent phrases.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import bounded_batches, cut, stored, table

MOST_WORDS = 5
#: Counters of a chunk, and chunks at least and at most.
CHUNK_BITS, LEAST_CHUNKS, MOST_CHUNKS = 18, 4, 4096
#: N-grams that a task gathers at least before it counts and sends them (and 8 times as many where there are so many counters that
#: they would lie thin), and bytes and words that are hashed at once.
HELD, BLOCK = 1 << 20, 1 << 20
#: Bytes of the texts that are taken apart at once; a longer text alone.
PORTION = 1 << 21
_BASES = np.array([0x9E3779B97F4A7C15, 0xD1342543DE82EF95], np.uint64)  # of bytes, of words; odd, so that they have inverses
_MIX = np.uint64(0xBF58476D1CE4E5B9)
_KINDS = np.zeros(256, np.uint8)
_KINDS[[0x20, 0x09]] = 1
_KINDS[[*b".,;:!?", *range(0x0A, 0x0E)]] = 2
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_PLACES = np.random.Generator(np.random.PCG64(11)).integers(0, 1 << 63, (2, 256), np.uint64)
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(which: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of a base and of its inverse modulo 2^64."""
    have = _POWERS.get(which)
    if have is None or len(have[0]) < n:
        base = int(_BASES[which])
        ones = np.empty((2, max(n, BLOCK + 64)), np.uint64)
        ones[:] = np.array([[base], [pow(base, -1, 1 << 64)]], np.uint64)
        ones[:, 0] = 1
        have = _POWERS[which] = tuple(np.multiply.accumulate(ones, axis=1))
    return have[0][:n], have[1][:n]


def windows(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, which: int) -> np.ndarray:
    """Polynomial fingerprints of values[start:end] by prefix sums; values don't exceed a block by much."""
    up, down = powers(which, len(values) + 1)
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[:-1], out=sums[1:])
    return (sums[ends] - sums[starts]) * down[starts]


class Words:
    """The words of a batch of texts: where they are, in which piece and text, and their fingerprints."""

    def __init__(self, texts: pa.Array, checked: bool):
        joined = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(texts)], pa.int32()), texts), "\n")
        data = np.frombuffer(joined.buffers()[2], np.uint8)[: pc.binary_length(joined)[0].as_py() or 0] if len(texts) else np.zeros(0, np.uint8)
        sizes = pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
        firsts = np.cumsum(np.append(0, sizes + 1))[:-1]
        kind = _KINDS[data]
        edge = np.flatnonzero(np.diff(kind == 0, prepend=False, append=False))
        self.starts, self.ends = edge[::2], edge[1::2]
        self.piece = np.cumsum(kind == 2, dtype=np.int32)[self.starts]
        self.text = np.searchsorted(firsts, self.starts, "right") - 1
        self.firsts = firsts
        self.prints, self.checks = np.empty(len(self.starts), np.uint64), np.empty(len(self.starts) if checked else 0, np.uint64)
        at = 0
        while at < len(self.starts):
            to = max(at + 1, int(np.searchsorted(self.ends, self.starts[at] + BLOCK, "right")))
            low = self.starts[at]
            part, s, e = data[low : self.ends[to - 1]], self.starts[at:to] - low, self.ends[at:to] - low
            if len(part) > 2 * BLOCK:  # one endless word, a block at a time
                cuts = [(k, min(k + BLOCK, len(part))) for k in range(0, len(part), BLOCK)]
                up = np.array([pow(int(_BASES[0]), k, 1 << 64) for k, _ in cuts], np.uint64)
                sums = np.array([self.raw(part[a:b], np.array([0]), np.array([b - a]))[0] for a, b in cuts])
                self.prints[at] = mixed((sums * up).sum(keepdims=True) + e.astype(np.uint64))[0]
                if checked:
                    self.checks[at] = mixed(np.array([self.tally(part[a:b], np.arange(a, b))[-1] for a, b in cuts], np.uint64).sum(keepdims=True) + e.astype(np.uint64))[0]
            else:
                self.prints[at:to] = mixed(self.raw(part, s, e) + (e - s).astype(np.uint64))
                if checked:
                    sums = self.tally(part, np.arange(len(part)) - np.repeat(s, np.diff(np.append(s, len(part)))))
                    self.checks[at:to] = mixed(sums[e] - sums[s] + (e - s).astype(np.uint64))
            at = to

    @staticmethod
    def raw(part: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
        return windows(_LOWER[part].astype(np.uint64) + np.uint64(1), s, e, 0)

    @staticmethod
    def tally(part: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Prefix sums of mixed bytes and places in their words: no polynomial, so that what collides in the one doesn't in the other."""
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(mixed(_PLACES[0][_LOWER[part]] + place.astype(np.uint64) * _PLACES[1][0]), out=sums[1:])
        return sums

    def grams(self, size: int, salts: np.ndarray, what: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First words of all n-grams of a size that lie inside a piece, and their fingerprints, salted by text and size."""
        n = len(self.starts) - size + 1
        if n <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        first = np.flatnonzero(self.piece[:n] == self.piece[size - 1 :])
        out = np.empty(len(first), np.uint64)
        for k in range(0, n, BLOCK):
            a, b = np.searchsorted(first, [k, k + BLOCK])
            if b > a:
                s = first[a:b] - k
                out[a:b] = windows(what[k : k + BLOCK + size], s, s + size, 1)
        return first, mixed(out ^ (salts[self.text[first]] + _PLACES[1][size]))


def portions(batches: Iterator[pa.RecordBatch], text: int) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about PORTION bytes of text."""
    for batch in batches:
        if batch.num_rows:
            at = np.cumsum(pc.binary_length(batch.column(text)).to_numpy(zero_copy_only=False).astype(np.int64)) // PORTION
            edges = [0, *(np.flatnonzero(np.diff(at)) + 1).tolist(), batch.num_rows]
            for a, b in zip(edges, edges[1:]):  # noqa: B905
                yield batch.slice(a, b - a)


def salts(langs: pa.Array) -> np.ndarray:
    from xxhash import xxh3_64_intdigest

    known = {x: xxh3_64_intdigest(x.encode("utf-8", "replace")) for x in set(langs.to_pylist())}
    return np.array([known[x] for x in langs.to_pylist()], np.uint64)


def counter_of(prints: np.ndarray, chunks: int) -> np.ndarray:
    return (prints >> np.uint64(32)) * np.uint64(chunks << CHUNK_BITS) >> np.uint64(32)


def counters(texts: DataFrame, many: int, least: int, held: int) -> np.ndarray:
    """One bit for each counter of `many` chunks: whether it reaches `least`. texts: lang, text, without nulls."""
    held = min(max(held, many << (CHUNK_BITS - 2)), 8 * held)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[np.ndarray] = []

        def sent() -> pa.RecordBatch:
            at, n = np.unique(np.concatenate(parts), return_counts=True)
            parts.clear()
            n = np.minimum(n, least).astype(np.uint8)
            edges = np.searchsorted(at, np.arange(many + 1) << CHUNK_BITS)
            chunks = np.flatnonzero(np.diff(edges))
            rows = []
            for c in chunks:
                dense = np.zeros(1 << CHUNK_BITS, np.uint8)
                part = slice(edges[c], edges[c + 1])
                dense[at[part] & ((1 << CHUNK_BITS) - 1)] = n[part]
                rows.append(pa.compress(dense, "zstd", asbytes=True))
            return pa.RecordBatch.from_arrays([pa.array(chunks, pa.int64()), pa.array(rows, pa.binary())], ["chunk", "data"])

        n = 0
        for batch in portions(batches, 1):
            words, salt = Words(batch.column(1), False), salts(batch.column(0))
            for size in range(1, MOST_WORDS + 1):
                parts.append(counter_of(words.grams(size, salt, words.prints)[1], many).astype(np.uint32))
                n += len(parts[-1])
                if n >= held:
                    yield sent()
                    n = 0
        if n:
            yield sent()

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sums = None, np.zeros(1 << CHUNK_BITS, np.uint16)
        done = lambda: pa.RecordBatch.from_arrays([pa.array([now], pa.int64()), pa.array([np.packbits(sums >= least).tobytes()], pa.binary())], ["chunk", "data"])
        for batch in batches:
            for chunk, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if chunk != now:
                    if now is not None:
                        yield done()
                    now, sums = chunk, np.zeros(1 << CHUNK_BITS, np.uint16)
                sums = np.minimum(sums + np.frombuffer(pa.decompress(data.as_buffer(), 1 << CHUNK_BITS, "zstd"), np.uint8), least)
        if now is not None:
            yield done()

    chunks = texts.mapInArrow(counted, "chunk long, data binary").repartition(F.col("chunk")).sortWithinPartitions("chunk")
    out = np.zeros(many << (CHUNK_BITS - 3), np.uint8)
    for r in chunks.mapInArrow(summed, "chunk long, data binary").toLocalIterator():
        size = 1 << (CHUNK_BITS - 3)
        out[r["chunk"] * size : (r["chunk"] + 1) * size] = np.frombuffer(r["data"], np.uint8)
    return out


FIELDS = pa.schema([("lang", pa.string()), ("size", pa.int8()), ("print", pa.uint64()), ("check", pa.uint64()), ("key", pa.int64()), ("at", pa.int32()), ("bytes", pa.int32()), ("n", pa.int64())])
FOUND = "lang string, size int, print long, check long, n long, key long, at long, bytes int"


class Tally:
    """Rows (print, check, size, lang, key, at, bytes, n) of n-grams, made one for each n-gram when there are many: the counts are
    added up, and of the pointers that with the least key stays."""

    def __init__(self, held: int):
        self.held, self.parts, self.rows = held, [], 0
        self.names: dict[str, int] = {}

    def code(self, langs: list[str]) -> np.ndarray:
        return np.array([self.names.setdefault(x, len(self.names)) for x in langs], np.int32)

    def add(self, *cols: np.ndarray) -> None:
        self.parts.append(cols)
        self.rows += len(cols[0])
        if self.rows >= 2 * self.held:
            self.merge()

    def merge(self) -> int:
        if len(self.parts) > 1 or self.parts and self.rows:
            cols = [np.concatenate(c) for c in zip(*self.parts, strict=True)]
            order = np.lexsort((cols[4], cols[1], cols[0]))
            p, c = cols[0][order], cols[1][order]
            first = np.flatnonzero(np.concatenate([[True], (p[1:] != p[:-1]) | (c[1:] != c[:-1])])) if len(p) else np.zeros(0, np.int64)
            self.parts = [(*(x[order[first]] for x in cols[:-1]), np.add.reduceat(cols[-1][order], first) if len(p) else cols[-1])]
            self.rows = len(first)
        return self.rows

    def taken(self) -> pa.RecordBatch:
        """All rows, merged; none stay."""
        self.merge()
        p, c, size, lang, key, at, length, n = self.parts.pop() if self.parts else (np.zeros(0, np.int64),) * 8
        self.rows = 0
        langs = pa.array(list(self.names), pa.string()).take(pa.array(lang.astype(np.int64)))
        return pa.RecordBatch.from_arrays([langs, *(pa.array(x.astype(f.type.to_pandas_dtype())) for x, f in zip((size, p, c, key, at, length, n), list(FIELDS)[1:], strict=True))], schema=FIELDS)


def fingerprints(texts: DataFrame, many: int, bitmap: np.ndarray, least: int, held: int, print_bits: int) -> DataFrame:
    """Per n-gram that reaches least: its fingerprints, count and a pointer; and (size 0) per language the number of words.

    A task counts its own n-grams first. It sends them in blocks, one for each range of fingerprints; the blocks of a range meet in
    one task, which adds them up one after the other.
    """
    shared = texts.sparkSession.sparkContext.broadcast(bitmap)

    def blocks(batch: pa.RecordBatch, part: np.ndarray) -> pa.RecordBatch:
        order = np.argsort(part, kind="stable")
        batch, part = batch.take(pa.array(order)), part[order]
        edges = np.flatnonzero(np.diff(part, prepend=-1)).tolist()
        data = []
        for a, b in zip(edges, [*edges[1:], len(part)], strict=True):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, FIELDS, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                out.write_batch(batch.slice(a, b - a))
            data.append(sink.getvalue().to_pybytes())
        return pa.RecordBatch.from_arrays([pa.array(part[edges], pa.int64()), pa.array(data, pa.binary())], ["part", "data"])

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bit = shared.value
        here, totals = Tally(held), Tally(held)

        def sent(tally: Tally) -> pa.RecordBatch:
            batch = tally.taken()
            prints = batch.column(2).to_numpy()
            part = ((prints >> np.uint64(32)) * np.uint64(many) >> np.uint64(32)).astype(np.int64)
            if print_bits < 64:
                batch = batch.set_column(2, FIELDS.field(2), pa.array(prints & np.uint64((1 << print_bits) - 1)))
            return blocks(batch, part)

        for batch in portions(batches, 1):
            words, salt = Words(batch.column(1), True), salts(batch.column(0))
            lang, names = here.code(batch.column(0).to_pylist()), totals.code(batch.column(0).to_pylist())
            key = batch.column(2).to_numpy(zero_copy_only=False)
            n = np.bincount(words.text, minlength=batch.num_rows)
            some = np.flatnonzero(n)
            none = np.zeros(len(some), np.int64)
            totals.add(salt[some], none.astype(np.uint64), none, names[some], none, none, none, n[some])
            ok = np.ones(len(words.starts) + 1, bool)
            for size in range(1, MOST_WORDS + 1):
                first, prints = words.grams(size, salt, words.prints)
                at = counter_of(prints, many).astype(np.int64)
                good = (bit[at >> 3] >> (7 - (at & 7)) & 1).astype(bool) & ok[first] & ok[first + (size > 1)]
                first, prints = first[good], prints[good]
                ok = np.zeros(len(words.starts) + 1, bool)
                ok[first] = True
                if not len(first):
                    break
                marks = np.zeros(len(first), np.uint64)
                for k in range(size):
                    marks = mixed(marks + words.checks[first + k])
                text, start = words.text[first], words.starts[first]
                place, length = (start - words.firsts[text]).astype(np.int32), (words.ends[first + size - 1] - start).astype(np.int32)
                here.add(prints, marks, np.full(len(first), size, np.int8), lang[text], key[text], place, length, np.ones(len(first), np.int64))
            if here.rows >= held and here.merge() >= held:
                yield sent(here)
        for tally in (here, totals):
            if tally.merge():
                yield sent(tally)

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sums = None, Tally(held)

        def done() -> pa.RecordBatch:
            t = sums.taken()
            t = t.filter(pc.or_(pc.greater_equal(t.column("n"), least), pc.equal(t.column("size"), 0)))
            signed = lambda c: pa.array(t.column(c).to_numpy().view(np.int64))
            cols = [t.column("lang"), t.column("size").cast(pa.int32()), signed("print"), signed("check"), t.column("n"), t.column("key"), t.column("at").cast(pa.int64()), t.column("bytes")]
            return pa.RecordBatch.from_arrays(cols, [f.split()[0] for f in FOUND.split(", ")])

        for batch in batches:
            for part, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if part != now:
                    if now is not None:
                        yield done()
                    now, sums = part, Tally(held)
                for t in pa.ipc.open_stream(data.as_buffer()):
                    sums.add(*(t.column(c).to_numpy() for c in ("print", "check", "size")), sums.code(t.column("lang").to_pylist()), *(t.column(c).to_numpy() for c in ("key", "at", "bytes", "n")))
        if now is not None:
            yield done()

    sent = texts.mapInArrow(counted, "part long, data binary").repartition(F.col("part")).sortWithinPartitions("part")
    return sent.mapInArrow(added, FOUND)


def checked(found: DataFrame, print_bits: int) -> DataFrame:
    """Rows (lang, size, print, check, phrase, n) whose phrase gives print and check."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, salt = Words(batch.column(4), True), salts(batch.column(0))
            size = batch.column(1).to_numpy()
            at, n = np.searchsorted(words.text, np.arange(batch.num_rows)), np.bincount(words.text, minlength=batch.num_rows)
            p, c = np.zeros(batch.num_rows, np.uint64), np.zeros(batch.num_rows, np.uint64)
            for s in np.unique(size):
                first, prints = words.grams(int(s), salt, words.prints)
                mine = np.flatnonzero((size == s) & (n == s))
                mine = mine[np.isin(at[mine], first)]
                p[mine] = prints[np.searchsorted(first, at[mine])]
                for k in range(s):
                    c[mine] = mixed(c[mine] + words.checks[at[mine] + k])
            if print_bits < 64:
                p = p & np.uint64((1 << print_bits) - 1)
            ok = (p.view(np.int64) == batch.column(2).to_numpy()) & (c.view(np.int64) == batch.column(3).to_numpy())
            out = batch.filter(pa.array(ok))
            yield pa.RecordBatch.from_arrays([out.column(0), out.column(1), out.column(4), out.column(5)], ["lang", "size", "phrase", "n"])

    return found.select("lang", "size", "print", "check", "phrase", "n").mapInArrow(run, "lang string, size int, phrase string, n long")


def pointed(texts: DataFrame, pointers: DataFrame, bits: int = 26) -> DataFrame:
    """The rows (key, text) that pointers may point to: a bit for each key's hash, 8 MB at most, keeps the others out of the join."""
    spot = F.pmod("key", F.lit(1 << bits))
    parts = pointers.groupBy(F.shiftright(spot, 15).alias("b")).agg(F.bitmap_construct_agg(spot.bitwiseAND(F.lit(32767).cast("long"))).alias("bits"))
    marks = {r["b"]: np.frombuffer(bytes(r["bits"]), np.uint8) for r in parts.toLocalIterator()}
    none = np.zeros(4096, np.uint8)
    at_most = max(marks, default=0) + 1
    shared = texts.sparkSession.sparkContext.broadcast(np.concatenate([marks.get(b, none) for b in range(at_most)]))

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bit = shared.value
        for batch in batches:
            at = batch.column(0).to_numpy() % (1 << bits)
            byte = np.minimum(at >> 3, len(bit) - 1)
            yield batch.filter(pa.array((byte == at >> 3) & (bit[byte] >> (at & 7) & 1 > 0)))

    return texts.mapInArrow(kept, "key long, text string")


def frequent(docs: DataFrame, least: int, lang: str, text: str, held: int = HELD, print_bits: int = 64) -> tuple[DataFrame, DataFrame]:
    """(lang, size, phrase, f) of all phrases of one to five words with f >= least, and (lang, n) of all languages with words."""
    bounded_batches(docs.sparkSession)
    texts = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    size = texts.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    many = min(MOST_CHUNKS, max(LEAST_CHUNKS, -(-size // (16 << CHUNK_BITS))))
    bitmap = counters(texts, many, least, held)
    keyed = texts.withColumn("key", F.xxhash64("text"))
    # In order of their keys, so that a task points to the text with its least key, and all tasks together to few texts.
    found = stored(fingerprints(keyed.sortWithinPartitions("key"), many, bitmap, least, held, print_bits))
    totals = cut(found.where("size = 0").groupBy("lang").agg(F.sum("n").alias("n")))
    pointers = found.where("size > 0")
    # Of texts with one key two are kept, if there are two: the fingerprints tell which one a pointer means.
    wanted = pointed(keyed.select("key", "text"), pointers).groupBy("key").agg(F.array_distinct(F.array(F.min("text"), F.max("text"))).alias("texts"))
    there = F.substring(F.col("text").cast("binary"), (F.col("at") + 1).cast("int"), F.col("bytes")).cast("string")
    phrase = F.regexp_replace(F.translate(there, UPPER, LOWER), "[ \t]+", " ")
    right = cut(checked(pointers.join(wanted, "key").withColumn("text", F.explode("texts")).withColumn("phrase", phrase), print_bits))
    return cut(right.groupBy("lang", "size", "phrase").agg(F.sum("n").alias("f")).where(F.col("f") >= least)), totals


def collocations(docs: DataFrame, least: int = 100, top: int = 2000, lang: str = "lang", text: str = "text", held: int = HELD, print_bits: int = 64) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's `top` phrases of two to five words by score, then a, then phrase.

    a, l and r count the phrase and its two parts, n the words of the language; score is floor(1000 a n / (l r)) of the cut that
    gives the least, of equals the first. A phrase inside a longer one that is as frequent is left out. Letters A-Z count as a-z.
    `least` must be at most 255, so that a counter is a byte.

    A null text is empty, a null language `und`. Repeated rows count again; ids are not read; ties beyond the phrase can't be; an
    empty table gives an empty result; other columns are ignored, whatever their names; texts of any length are read whole.
    """
    if not 1 <= least <= 255:
        raise ValueError("least must be from 1 to 255")
    freq, totals = frequent(docs, least, lang, text, held, print_bits)
    words, size = F.split("phrase", " "), F.col("size")
    part = lambda start, n: F.array_join(F.slice(words, start, n), " ")
    some = freq.where("size > 1")
    cuts = some.withColumn("k", F.explode(F.sequence(F.lit(1), size - 1))).select("lang", "phrase", "k", F.col("f").alias("a"), part(F.lit(1), F.col("k")).alias("left"), part(F.col("k") + 1, size - F.col("k")).alias("right"))
    of = lambda side, name: freq.select("lang", F.col("phrase").alias(side), F.col("f").alias(name))
    both = cuts.join(of("left", "l"), ["lang", "left"]).join(of("right", "r"), ["lang", "right"]).join(totals, "lang")
    # Decimals of 38 digits hold 1000 a n and l r exactly; the quotient is at most 1000 n.
    score = F.expr("(CAST(a AS DECIMAL(16,0)) * CAST(n AS DECIMAL(16,0)) * CAST(1000 AS DECIMAL(4,0))) div (CAST(l AS DECIMAL(18,0)) * CAST(r AS DECIMAL(18,0)))")
    scored = cut(both.withColumn("score", score)).groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("b"))
    inner = some.where("size > 2").withColumn("m", F.explode(F.sequence(F.lit(2), size - 1))).withColumn("s", F.explode(F.sequence(F.lit(1), size - F.col("m") + 1)))
    inside = cut(inner.select("lang", part(F.col("s"), F.col("m")).alias("phrase"), "f").groupBy("lang", "phrase").agg(F.max("f").alias("whole")))
    left = scored.join(inside, ["lang", "phrase"], "left").where(F.col("whole").isNull() | (F.col("whole") < F.col("a")))
    best = Window.partitionBy("lang").orderBy(F.desc("b.score"), F.desc("a"), "phrase")
    ranked = left.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "b.l", "b.r", "n", "b.score")


def op11_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS id, coalesce(lang, 'und') AS lang,
  translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
p AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda w: w <> '') AS w
  FROM (SELECT lang, unnest(regexp_split_to_array(text, '[.,;:!?\x0A-\x0D]')) AS piece FROM d)),
t AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM p GROUP BY lang HAVING sum(len(w)) > 0),
s AS (SELECT lang, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM p, (SELECT unnest([1, 2, 3, 4, 5]) AS size) z WHERE len(w) >= size),
g AS (SELECT lang, size, array_to_string(w[i:i + size - 1], ' ') AS phrase FROM s),
f AS (SELECT lang, size, phrase, count(*) AS f FROM g GROUP BY ALL HAVING count(*) >= 100),
c AS (SELECT f.lang, f.phrase, f.f AS a, f.size, unnest(range(1, f.size)) AS k, string_split(f.phrase, ' ') AS w FROM f WHERE f.size > 1),
b AS (SELECT c.lang, c.phrase, c.a, c.k, x.f AS l, y.f AS r, t.n,
  CAST((CAST(1000 AS HUGEINT) * c.a * t.n) // (CAST(x.f AS HUGEINT) * y.f) AS BIGINT) AS score
  FROM c JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(c.w[1:c.k], ' ')
  JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(c.w[c.k + 1:c.size], ' ') JOIN t ON t.lang = c.lang),
best AS (SELECT * FROM b QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
i AS (SELECT lang, f, size, m, string_split(phrase, ' ') AS w, unnest(range(1, size - m + 2)) AS j
  FROM (SELECT *, unnest(range(2, size)) AS m FROM f WHERE size > 2) q),
o AS (SELECT lang, array_to_string(w[j:j + m - 1], ' ') AS phrase, max(f) AS whole FROM i GROUP BY ALL),
k AS (SELECT best.* FROM best LEFT JOIN o USING (lang, phrase) WHERE o.whole IS NULL OR 100 * o.whole < 100 * best.a)
SELECT lang, rank, phrase, a, l, r, n, score FROM (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM k) WHERE rank <= 2000
"""
