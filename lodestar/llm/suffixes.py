"""Removal of repeated byte strings by blockwise suffix sorting with a difference-cover sample.

A byte goes if a string of `length` bytes that covers it also starts anywhere else. Sorting every suffix of the corpus would move
the corpus some hundred times over, so suffixes are first dealt into buckets that equal strings share: the bucket of a start is
the least hash among the `ANCHOR`-byte strings inside its `length` bytes (the leftmost of equal ones), its anchor. An anchor serves
a run of consecutive starts.

1. Buckets with one anchor hold no repeat, and go.
2. Anchors of a bucket whose whole run of text is equal are repeats of each other as a whole, and need no sorting. A 128-bit digest
   of the run's bytes tells; it owes nothing to the bucket's hash.
3. The texts that are left (one for each different run) are sorted bucket by bucket: by the first bytes, long ties by the rank of
   the next position of a difference cover, whose ranks over the block were found before by doubling. Neighbours in the order that
   agree in `length` bytes are repeats; here the bytes themselves are compared, hashes only bring them together.

A block holds whole buckets of about `block` texts. A bucket with more texts than that isn't gathered: its starts are counted by
the hash of their strings instead, with partial sums before the shuffle.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop, stored, table

ANCHOR = 32
#: A perfect difference set: every residue is a difference of two members, so any two positions have a common shift into it.
PERIOD, COVER = 21, (3, 6, 7, 12, 14)
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_29, _32 = np.uint64(29), np.uint64(32)


def window_hashes(raw: bytes) -> np.ndarray:
    """Hashes of all ANCHOR-byte strings, from the eight bytes at every position by doubling."""
    b = np.frombuffer(raw, np.uint8)
    h = np.ndarray((len(b) - 7,), np.uint64, b, strides=(1,)) * _M1
    h ^= h >> _32
    width = 8
    while width < ANCHOR:
        h = h[: len(h) - width] * _M2 + h[width:]
        h ^= h >> _29
        width *= 2
    h *= _M1
    h ^= h >> _32
    return h


def sliding(x: np.ndarray, width: int, least: np.ufunc) -> np.ndarray:
    """Least (or greatest) of every run of `width` values."""
    have = 1
    while 2 * have <= width:
        x = least(x[:-have], x[have:])
        have *= 2
    return least(x[: len(x) - (width - have)], x[width - have :]) if have < width else x


def anchors(raw: bytes, length: int, digest: bool = True) -> tuple[np.ndarray, ...]:
    """hash, run digest (two halves of 64 bits; none without digest), position, first and last start of every anchor of a text."""
    starts = len(raw) - length + 1
    if starts < 1:
        none = np.empty(0, np.int64)
        return none, np.empty((0, 2), np.int64), none, none, none
    h = window_hashes(raw)
    span = length - ANCHOR + 1
    m = sliding(h, span, np.minimum)  # of every start
    edges = np.flatnonzero(m[1:] != m[:-1]) + 1
    lo = np.concatenate([[0], edges])
    hi = np.concatenate([edges - 1, [starts - 1]])
    # Within starts of one least hash the leftmost position may still move to an equal one; those runs are taken apart.
    at, los, his = [], [], []
    for a, b, v in zip(lo.tolist(), hi.tolist(), m[lo], strict=True):
        where = np.flatnonzero(h[a : b + span] == v) + a
        if len(where) == 1 or where[0] >= b:
            at.append(int(where[0]))
            los.append(a)
            his.append(b)
            continue
        s = a
        for p in where.tolist():
            if p >= s:
                e = min(p, b)
                at.append(p)
                los.append(s)
                his.append(e)
                s = e + 1
                if s > b:
                    break
    p, lo, hi = np.array(at), np.array(los), np.array(his)
    digests = b"".join(hashlib.blake2b(raw[a : b + length], digest_size=16).digest() for a, b in zip(los, his, strict=True)) if digest else b""
    return h[p].view(np.int64), np.frombuffer(digests, np.int64).reshape(-1, 2), p, lo, hi


def _ranks(columns: list[np.ndarray]) -> np.ndarray:
    """Dense ranks of rows given by their columns, first column first; equal rows have equal ranks."""
    order = np.lexsort(columns[::-1])
    new = np.zeros(len(order), bool)
    for c in columns:
        new[1:] |= c[order[1:]] != c[order[:-1]]
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(new)
    return out


def repeated(frames: np.ndarray, bucket: np.ndarray, first: np.ndarray, last: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which (text, start) of a block also occur elsewhere in the bucket. frames: a text per row, its anchor in one column for all,
    zeros beside it; first and last: the columns of its starts."""
    n, width = frames.shape
    padded = np.zeros((n, width + 32), np.uint8)
    padded[:, :width] = frames
    flat = padded.ravel()
    words = np.ndarray((len(flat) - 7,), ">u8", flat, strides=(1,))

    def key(row: np.ndarray, col: np.ndarray, k: int) -> np.ndarray:
        return words[row * (width + 32) + np.minimum(col + 8 * k, width + 24)].astype(np.uint64)

    # Ranks of the cover sample: by 24 bytes, then doubled until they reach the end of the texts.
    cover = np.array([c for c in range(width) if c % PERIOD in COVER])
    row, col = np.repeat(np.arange(n), len(cover)), np.tile(cover, n)
    rank = _ranks([key(row, col, k) for k in range(3)]).reshape(n, len(cover)) + 1
    step = PERIOD
    place = {c: k for k, c in enumerate(cover.tolist())}
    while step < width:
        follow = np.zeros_like(rank)
        for k, c in enumerate(cover.tolist()):
            if c + step in place:
                follow[:, k] = rank[:, place[c + step]]
        rank = _ranks([rank.ravel(), follow.ravel()]).reshape(rank.shape) + 1
        step *= 2
    # The block's suffixes: bucket, column, first bytes, and the rank of the next cover position for what is still tied.
    counts = last - first + 1
    row = np.repeat(np.arange(n), counts)
    col = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts) + first[row]
    following = np.searchsorted(cover, np.arange(width))
    nearest = following[col]
    tie = np.where(nearest < len(cover), rank[row, np.minimum(nearest, len(cover) - 1)], 0)
    heads = [key(row, col, k) for k in range(3)]
    order = np.lexsort([tie, *heads[::-1], col, bucket[row]])
    a, b = order[:-1], order[1:]
    same = (bucket[row[a]] == bucket[row[b]]) & (col[a] == col[b])
    for x in heads:
        same &= x[a] == x[b]
    pairs = np.flatnonzero(same)
    for k in range(0, len(pairs), 65536):
        part = pairs[k : k + 65536]
        x = row[a[part]] * (width + 32) + col[a[part]]
        y = row[b[part]] * (width + 32) + col[b[part]]
        equal = np.ones(len(part), bool)
        for s in range(0, length, 8):
            s = min(s, length - 8)
            equal &= words[x + s] == words[y + s]
        same[part] = equal
    out = np.zeros(len(order), bool)
    out[a[same]] = True
    out[b[same]] = True
    return row, col, out


def _runs(row: np.ndarray, col: np.ndarray, hit: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(row, first, last) of consecutive hits."""
    row, col = row[hit], col[hit]
    if len(row):
        breaks = np.flatnonzero((row[1:] != row[:-1]) | (col[1:] != col[:-1] + 1)) + 1
        for s, e in zip([0, *breaks.tolist()], [*breaks.tolist(), len(row)], strict=True):
            yield int(row[s]), int(col[s]), int(col[e - 1])


CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Most bits of the filter for texts that are fetched: 128 MB; it has some 16 for each text up to there, and three marks for each.
MOST_BITS = 30
_ROW = np.dtype([("a", ">u8"), ("b", ">u8")])


def places(rid: np.ndarray, p: np.ndarray, bits: int) -> list[np.ndarray]:
    """Where the three marks of anchors (row and position) stand among 2^bits."""
    h = rid["a"].astype(np.uint64) ^ ((rid["b"].astype(np.uint64) + p.astype(np.uint64) * _M1) * _M2)
    out = []
    for _ in range(3):
        h = (h ^ (h >> _32)) * _M2
        h = (h ^ (h >> _29)) * _M1
        out.append((h >> np.uint64(64 - bits)).astype(np.int64))
    return out


def marks(wanted: DataFrame, bits: int) -> np.ndarray:
    """The filter of (rid, p), as bytes. The driver gets it in pieces of 4 kB."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rid = np.frombuffer(b"".join(batch.column(0).to_pylist()), _ROW)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(places(rid, batch.column(1).to_numpy(), bits)))], ["at"])

    low = F.col("at").bitwiseAND(F.lit(32767).cast("long"))
    parts = wanted.select("rid", "p").mapInArrow(found, "at long").groupBy(F.shiftright("at", 15).alias("b")).agg(F.bitmap_construct_agg(low).alias("bits"))
    out = np.zeros(1 << (bits - 3), np.uint8)
    for r in parts.toLocalIterator():
        out[r["b"] << 12 : (r["b"] + 1) << 12] = np.frombuffer(r["bits"], np.uint8)
    return out


@contextmanager
def tidy(spark: SparkSession) -> Iterator[None]:
    """What runs inside deletes its shuffle files when it ends, not some time later."""
    before = spark.conf.get(CLEAN, None)
    spark.conf.set(CLEAN, "true")
    try:
        yield
    finally:
        spark.conf.unset(CLEAN) if before is None else spark.conf.set(CLEAN, before)


def repeated_spans(docs: DataFrame, length: int, block: int) -> DataFrame:
    """(rid, spans): a row's stretches (start, stop) of bytes that repeated strings cover; they may overlap. docs: (rid, text).

    Tables and shuffles on the way are deleted as soon as nothing reads them.
    """
    fields = "rid binary, h array<long>, e array<long>, f array<long>, q array<long>"

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols: list[list] = [[], [], [], []]
            for t in batch.column(1).to_pylist():
                h, e, p, lo, hi = anchors((t or "").encode("utf-8", "replace"), length)
                # One number for position and run: fewer columns to shuffle.
                for c, x in zip(cols, (h, e[:, 0], e[:, 1], (p << 24) | ((p - lo) << 12) | (hi - lo)), strict=True):
                    c.append(x)
            lists = [pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, c)]), pa.int32()), pa.array(np.concatenate(c) if c else [], pa.int64(), safe=False)) for c in cols]
            yield pa.RecordBatch.from_arrays([batch.column(0), *lists], ["rid", "h", "e", "f", "q"])

    found = stored(docs.mapInArrow(find, fields))  # read twice
    rows = found.select("rid", F.inline(F.arrays_zip("h", "e", "f", "q"))).withColumn("g", F.shiftright("h", 32).cast("int"))
    # Buckets are counted by half their hash: what meets by chance there is told apart below.
    # Counts are stored before joins on the same key: the join then reads two plain shuffles, and a common bucket can be split.
    many = stored(found.select(F.explode("h").alias("h")).groupBy(F.shiftright("h", 32).cast("int").alias("g")).count().where("count > 1").select("g"))
    position = {"p": F.shiftright("q", 24).cast("int"), "lo": (F.shiftright("q", 24) - F.shiftright("q", 12).bitwiseAND(4095)).cast("int")}
    position["hi"] = (position["lo"] + F.col("q").bitwiseAND(4095)).cast("int")
    hits = stored(rows.join(many, "g", "left_semi").select("rid", "h", "e", "f", "q"))
    drop(found)
    # For equal runs one text stands. It is chosen while they are counted, so that no join by bucket is followed by an aggregate.
    runs = stored(hits.groupBy("h", "e", "f").agg(F.count("*").alias("count"), F.min(F.struct("rid", "q")).alias("one")))
    whole = hits.join(runs.where("count > 1").select("h", "e", "f"), ["h", "e", "f"], "left_semi").select("rid", position["lo"].alias("start"), (position["hi"] + length).alias("stop"))
    mixed = stored(runs.groupBy("h").agg(F.count("*").alias("texts"), F.min("count").alias("least")).where("texts > 1 AND least = 1").select("h", "texts"))
    wanted = stored(runs.join(mixed, "h").select("h", "one.rid", F.shiftright("one.q", 24).cast("int").alias("p"), (F.col("texts") > block).alias("hot")))
    # Texts are fetched by a second look at all rows, with a filter of the anchors that are wanted: so no document is shuffled to meet
    # its anchors. The few that pass by chance are left out below (in hot buckets they are counted like the others).
    spark = docs.sparkSession
    n = wanted.count()
    bits = min(MOST_BITS, max(15, (16 * n).bit_length()))
    shared = spark.sparkContext.broadcast(marks(wanted, bits))
    # Of these there are no more than texts by `block`.
    common = spark.sparkContext.broadcast(np.array([r["h"] for r in mixed.where(F.col("texts") > block).select("h").toLocalIterator()], np.int64))
    wide = 2 * length - ANCHOR

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap, seen = shared.value, set()  # rows that are there twice are fetched once a task
        for batch in batches:
            out: list[tuple] = []
            for rid, t in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                raw = (t or "").encode("utf-8", "replace")
                if len(raw) < length or rid in seen:
                    continue
                h, _, p, lo, hi = anchors(raw, length, digest=False)
                take = np.ones(len(p), bool)
                for at in places(np.frombuffer(rid, _ROW), p, bits):
                    take &= (bitmap[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
                if take.any():
                    seen.add(rid)
                    h, p, lo, hi = (x[take] for x in (h, p, lo, hi))
                    hot = np.isin(h, common.value)
                    out += [(rid, *x, raw[x[2] : x[3] + length]) for x in zip(h.tolist(), p.tolist(), lo.tolist(), hi.tolist(), hot.tolist(), strict=True)]
            types = (pa.binary(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.bool_(), pa.binary())
            cols = list(zip(*out, strict=True)) or [()] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, types, strict=True)], ["rid", "h", "p", "lo", "hi", "hot", "bytes"])

    frames = stored(docs.mapInArrow(fetch, "rid binary, h long, p int, lo int, hi int, hot boolean, bytes binary"))
    packs = max(1, wanted.where("NOT hot").count() // block)

    def sort(group: pa.Table, asked: pa.Table) -> pa.Table:
        left = set(zip(asked.column("rid").to_pylist(), asked.column("p").to_pylist(), strict=True))
        own = []
        for k, x in enumerate(zip(group.column("rid").to_pylist(), group.column("p").to_pylist(), strict=True)):
            if x in left:  # each once
                left.remove(x)
                own.append(k)
        group = group.take(pa.array(own, pa.int64()))
        rid = group.column("rid").to_pylist()
        h, p, lo, hi = (group.column(c).to_numpy() for c in ("h", "p", "lo", "hi"))
        grid = np.zeros((len(rid), wide), np.uint8)
        shift = length - ANCHOR - (p - lo)
        for k, b in enumerate(group.column("bytes").to_pylist()):
            grid[k, shift[k] : shift[k] + len(b)] = np.frombuffer(b, np.uint8)
        out = []
        order = np.argsort(h, kind="stable")
        cuts = np.flatnonzero(h[order][1:] != h[order][:-1]) + 1
        at = 0
        ends = [*cuts.tolist(), len(order)]
        while at < len(order):  # whole buckets, a block at a time
            end = next((e for e in ends if e >= at + block), len(order))
            part = order[at:end]
            row, col, hit = repeated(grid[part], h[part], shift[part], shift[part] + (hi - lo)[part], length)
            for r, c0, c1 in _runs(row, col, hit):
                k = part[r]
                base = int(lo[k] - shift[k])
                out.append((rid[k], base + c0, base + c1 + length))
            at = end
        cols = list(zip(*out, strict=True)) or [(), (), ()]
        return pa.table({"rid": pa.array(cols[0], pa.binary()), "start": pa.array(cols[1], pa.int32()), "stop": pa.array(cols[2], pa.int32())})

    def starts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rids, los, keys = [], [], []
            for rid, lo, hi, b in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                for s in range(hi - lo + 1):
                    rids.append(rid)
                    los.append(lo + s)
                    keys.append(hashlib.blake2b(b[s : s + length], digest_size=16).digest())
            yield pa.RecordBatch.from_arrays([pa.array(rids, pa.binary()), pa.array(los, pa.int32()), pa.array(keys, pa.binary())], ["rid", "start", "key"])

    packed = lambda df: df.where("NOT hot").withColumn("pack", F.pmod(F.xxhash64("h"), F.lit(packs))).groupBy("pack")
    sorted_ = packed(frames).cogroup(packed(wanted)).applyInArrow(sort, "rid binary, start int, stop int")
    hot = frames.where("hot").select("rid", "lo", "hi", "bytes").mapInArrow(starts, "rid binary, start int, key binary")
    twice = stored(hot.groupBy("key").count().where("count > 1").select("key"))
    counted = hot.join(twice, "key", "left_semi").select("rid", "start", (F.col("start") + length).alias("stop"))
    # Sums of openings and closings would need an order; a text's stretches are bounded by its length, so they are gathered.
    spans = stored(whole.unionByName(sorted_).unionByName(counted).groupBy("rid").agg(F.collect_set(F.struct("start", "stop")).alias("spans")))
    for done in (many, hits, runs, mixed, wanted, frames, twice):
        drop(done)
    return spans


def remove_repeats(docs: DataFrame, length: int = 200, block: int = 4096, doc_id: str = "doc_id", text: str = "text", keep_text: bool = False) -> DataFrame:
    """Per row of docs: doc_id, n_bytes, n_removed, n_spans, kept_sha256, and kept (the remaining bytes) if keep_text.

    Texts are UTF-8 bytes; null is empty. Strings are judged on the input and never cross texts; a row that is there twice repeats
    itself. Texts shorter than `length` stay whole. An empty table gives an empty result; other columns are ignored.
    """
    if not 2 * ANCHOR <= length < 4096:
        raise ValueError(f"strings of {2 * ANCHOR} to 4095 bytes")
    kind = dict(docs.dtypes)[doc_id]
    base = docs.select(F.col(doc_id).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    base = base.select("id", F.unhex(F.md5(F.concat_ws(":", F.coalesce(F.concat(F.lit("k"), F.col("id").cast("string")), F.lit("n")), F.md5("text")).cast("binary"))).alias("rid"), "text")
    with tidy(docs.sparkSession):
        mine = repeated_spans(base.select("rid", "text"), length, block)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, removed, runs, shas, kept = [], [], [], [], []
            for t, spans_ in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                raw = t.encode("utf-8", "replace")
                parts, at, gone, n, end = [], 0, 0, 0, -1
                for s in sorted(spans_ or [], key=lambda x: (x["start"], x["stop"])):
                    if s["start"] > end:
                        n += 1
                        parts.append(raw[at : s["start"]])
                        gone += s["stop"] - s["start"]
                        at = end = s["stop"]
                    elif s["stop"] > end:
                        gone += s["stop"] - end
                        at = end = s["stop"]
                rest = b"".join([*parts, raw[at:]])
                sizes.append(len(raw))
                removed.append(gone)
                runs.append(n)
                shas.append(hashlib.sha256(rest).hexdigest())
                kept.append(rest)
            cols = [batch.column(0), *(pa.array(x, pa.int64()) for x in (sizes, removed, runs)), pa.array(shas, pa.string())]
            names = [doc_id, "n_bytes", "n_removed", "n_spans", "kept_sha256"]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(kept, pa.binary())] if keep_text else cols, [*names, "kept"] if keep_text else names)

    out = base.join(mine, "rid", "left").select("id", "text", "spans")
    return out.mapInArrow(apply, f"{doc_id} {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", kept binary" if keep_text else ""))


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"))
