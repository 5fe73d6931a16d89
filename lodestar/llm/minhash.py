"""MinHash near-duplicates with sequential Bayesian verification.

Texts with the same shingle set form a class first. One signature per class is banded; candidates of a bucket are compared in
batches of signature values, and given up as soon as the posterior probability that their similarity reaches the threshold is
under the chosen miss probability. Survivors are verified on their full sets.

Buckets never emit all their pairs. In each round a bucket compares one member of each component in it with one leader; links
contract components, and only buckets that still hold several components go on. What is left after the rounds (members that
similar texts surround but no tested pair links) is compared inside tasks: buckets that share members form a cluster, a cluster
is cut into chunks, and each pair of chunks is one group, which runs the same tests on the pairs that lie in different
components and gives back only links that join components. No link is lost, and no group is larger than two chunks.

Every join shuffles both sides. Small sides would else be broadcast, dozens of them up to the session's limit, all by way of the driver.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD, bounded_batches, cut, met, stored, table, unused
from .graph import components

WORDS = 5
BANDS, ROWS = 24, 5
HASHES = BANDS * ROWS
_SEEDS = np.random.Generator(np.random.PCG64(20240501)).integers(1, 1 << 63, (2, HASHES), np.uint64)
_A, _B = _SEEDS[0] * np.uint64(2) + np.uint64(1), _SEEDS[1]


def shingles(text: str | None) -> np.ndarray:
    """The distinct 5-word shingles as sorted 64-bit hashes; of fewer words the whole sequence; without words none."""
    from xxhash import xxh3_64_intdigest

    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxh3_64_intdigest, words), np.uint64, len(words))
    size = min(WORDS, len(words))
    out = np.full(len(words) - size + 1, size, np.uint64)
    for k in range(size):
        out = (out ^ h[k : len(words) - size + 1 + k]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(32)
    return np.unique(out)


def signature(grams: np.ndarray) -> np.ndarray:
    best = np.full(HASHES, 0xFFFFFFFF, np.uint32)
    for k in range(0, len(grams), 2048):
        part = grams[k : k + 2048]
        best = np.minimum(best, ((part[:, None] * _A + _B) >> np.uint64(32)).astype(np.uint32).min(axis=0))
    return best


def least_matches(threshold: float, miss: float, step: int) -> list[tuple[int, int]]:
    """(n, m): with fewer than m matches among the first n values, P(similarity >= threshold) < miss under a flat prior."""
    out = []
    for n in range(step, HASHES + 1, step):
        below, m = 0.0, -1
        while below < miss:  # P(Beta(m + 1, n - m + 1) >= t) = P(Bin(n + 1, t) <= m)
            m += 1
            below += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        out.append((n, m))
    return out


def row_key(doc_id: str, text: str) -> Column:
    """A digest of id and text: the name of a row, and of the rows that are equal to it."""
    return F.md5(F.concat_ws(":", F.coalesce(F.concat(F.lit("k"), F.col(doc_id).cast("string")), F.lit("n")), F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary"))).cast("binary"))


def features(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """Per row its id and key, the size and a digest of its shingle set, and its signature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ns, fps, sigs = [], [], []
            for t in batch.column(2).to_pylist():
                g = shingles(t)
                ns.append(len(g))
                fps.append(blake2b(g.tobytes(), digest_size=16).digest() if len(g) else None)
                sigs.append(signature(g).tobytes() if len(g) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(ns, pa.int64()), pa.array(fps, pa.binary()), pa.array(sigs, pa.binary())], ["id", "row", "n_shingles", "fp", "sig"])

    return docs.select(doc_id, row_key(doc_id, text).alias("row"), text).mapInArrow(run, f"id {dict(docs.dtypes)[doc_id]}, row string, n_shingles long, fp binary, sig binary")


def shingle_sets(texts: DataFrame) -> DataFrame:
    """(id, grams) of (id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingles(t).tobytes() for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], ["id", "grams"])

    return texts.mapInArrow(run, "id long, grams binary")


def bayes(pairs: DataFrame, tests: list[tuple[int, int]]) -> DataFrame:
    """Pairs (a, b, sa, sb) that the signature batches don't rule out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x, y = (np.frombuffer(b"".join(c.to_pylist()), np.uint32).reshape(-1, HASHES) for c in (batch.column(2), batch.column(3)))
            alive, matches, done = np.arange(len(x)), np.zeros(len(x), np.int64), 0
            for n, m in tests:
                matches[alive] += (x[alive, done:n] == y[alive, done:n]).sum(axis=1)
                alive, done = alive[matches[alive] >= m], n
            keep = pa.array(alive)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(keep), batch.column(1).take(keep)], ["a", "b"])

    return pairs.select("a", "b", "sa", "sb").mapInArrow(run, "a long, b long")


def exact(pairs: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b, ga, gb) with 100 * intersection >= percent * union on the full sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for k, (p, q) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)):
                x, y = np.frombuffer(p, np.uint64), np.frombuffer(q, np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                if 100 * both >= percent * (len(x) + len(y) - both):
                    keep.append(k)
            keep = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(keep), batch.column(1).take(keep)], ["a", "b"])

    return pairs.select("a", "b", "ga", "gb").mapInArrow(run, "a long, b long")


def _join_chunk(ids: list, comps: np.ndarray, sides: np.ndarray, sigs: np.ndarray, grams: list[np.ndarray], tests: list[tuple[int, int]], percent: int) -> list[tuple]:
    """Links that join different components; with two sides only pairs across them are looked at."""
    sizes = np.array([len(g) for g in grams])
    offsets = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    vocabulary, flat = np.unique(np.concatenate(grams), return_inverse=True)
    mine, links = np.zeros(len(vocabulary), np.int64), []
    two = sides.min() != sides.max()
    for i in range(len(ids)):
        alive = np.arange(i + 1, len(ids))
        alive = alive[(comps[alive] != comps[i]) & (~two | (sides[alive] != sides[i]))]
        matches, done = np.zeros(len(ids), np.int64), 0
        for n, m in tests:
            if not len(alive):
                break
            matches[alive] += (sigs[alive, done:n] == sigs[i, done:n]).sum(axis=1)
            alive, done = alive[matches[alive] >= m], n
        if not len(alive):
            continue
        own = flat[offsets[i] : offsets[i] + sizes[i]]
        mine[own] = 1
        both = np.array([mine[flat[offsets[j] : offsets[j] + sizes[j]]].sum() for j in alive]) if len(alive) < 32 else np.add.reduceat(mine[flat], offsets)[alive]
        mine[own] = 0
        for j in alive[100 * both >= percent * (sizes[i] + sizes[alive] - both)]:
            if comps[i] != comps[j]:
                links.append((ids[i], ids[j]))
                comps[comps == comps[j]] = comps[i]
    return links


def rest(placed: DataFrame, sigs: DataFrame, sets: DataFrame, tests: list[tuple[int, int]], percent: int, chunk: int, most_bytes: int = 1 << 25) -> DataFrame:
    """Links (a, b) between components among the members (key, id, comp) of buckets that hold several.

    A chunk holds about `chunk` members, and fewer where their sets would take more than `most_bytes`.
    """
    first = cut(placed.groupBy("key").agg(F.min("id").alias("a")))
    cluster = components(met(placed, first, "key").select("a", F.col("id").alias("b")).distinct(), out="cluster")
    weights = sets.select("id", F.octet_length("grams").cast("long").alias("bytes"))
    ids = cut(met(met(cluster, placed.select("id", "comp").distinct(), "id"), weights, "id"))
    need = lambda n, b: F.greatest(F.ceil(n / chunk), F.ceil(b / F.lit(most_bytes)), F.lit(1))
    sizes = cut(ids.groupBy("cluster").agg(need(F.count("*"), F.sum("bytes")).cast("int").alias("chunks")))
    packs = ids.agg(need(F.count("*"), F.coalesce(F.sum("bytes"), F.lit(0)))).first()[0]
    rows = met(met(met(ids, sizes, "cluster"), sigs, "id"), sets, "id")
    rows = rows.withColumn("c", F.pmod(F.xxhash64("id"), F.col("chunks")).cast("int")).withColumn("d", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    pack = F.when(F.col("chunks") == 1, F.pmod(F.xxhash64("cluster"), F.lit(packs))).otherwise(F.xxhash64("cluster", F.least("c", "d"), F.greatest("c", "d")))
    rows = rows.select(pack.alias("pack"), "cluster", F.least("c", "d").alias("lo"), F.greatest("c", "d").alias("hi"), "c", "id", "comp", "sig", "grams")

    def run(group: pa.Table) -> pa.Table:
        names = group.column("id").to_pylist()
        code = {x: k for k, x in enumerate(dict.fromkeys(group.column("comp").to_pylist()))}
        comps = np.array([code[x] for x in group.column("comp").to_pylist()])
        sides = group.column("c").to_numpy()
        sig = np.frombuffer(b"".join(group.column("sig").to_pylist()), np.uint32).reshape(-1, HASHES)
        grams = [np.frombuffer(g, np.uint64) for g in group.column("grams").to_pylist()]
        parts: dict[tuple, list[int]] = {}
        for k, key in enumerate(zip(group.column("cluster").to_pylist(), group.column("lo").to_pylist(), group.column("hi").to_pylist(), strict=True)):
            parts.setdefault(key, []).append(k)
        links = []
        for at in parts.values():
            if len(at) > 1:
                links += _join_chunk([names[k] for k in at], comps[at], sides[at], sig[at], [grams[k] for k in at], tests, percent)
        return pa.table({"a": pa.array([a for a, _ in links], pa.int64()), "b": pa.array([b for _, b in links], pa.int64())})

    return cut(rows.groupBy("pack").applyInArrow(run, "a long, b long"))


def linked(docs: DataFrame, percent: int, miss: float, step: int, rounds: int, chunk: int, doc_id: str, text: str) -> tuple[DataFrame, DataFrame]:
    """(rows, classes): per row of docs id, row (its key), n_shingles and fp (null without words); per fp comp, the component of its
    class, and component_id, the least id in it (null if no row of it has one).

    Everything between is keyed by classes, numbered anew, so that an id with several texts, or none, loses no link.
    """
    bounded_batches(docs.sparkSession)
    tests = least_matches(percent / 100, miss, step)
    feat = stored(features(docs, doc_id, text))
    # Results of aggregates are cut off before joins on the same key, so that these read them by a plain shuffle and a large class or
    # bucket can be split among tasks.
    every = feat.where("fp IS NOT NULL").groupBy("fp").agg(F.min("id").alias("rep"), F.min("row").alias("row"), F.first("sig").alias("sig"))
    every = stored(every.select(F.monotonically_increasing_id().alias("cid"), "*"))
    keys = F.array(*[F.xxhash64(F.lit(k), F.substring("sig", 4 * ROWS * k + 1, 4 * ROWS)) for k in range(BANDS)])
    rows = cut(every.select(F.col("cid").alias("id"), F.explode(keys).alias("key")))
    many = rows.groupBy("key").agg(F.count("*").alias("n"), F.min("id").alias("lo"), F.max("id").alias("hi"), F.expr("bit_xor(xxhash64(id))").alias("x"), F.expr("bit_xor(xxhash64(id, 1))").alias("y")).where("n > 1")
    many = many.groupBy("n", "lo", "hi", "x", "y").agg(F.min("key").alias("key")).select("key")  # equal buckets once
    members = cut(met(rows, many, "key"))
    ids = cut(members.select("id").distinct())
    wanted = met(every, ids, F.col("cid") == F.col("id"), "left_semi")
    sigs = cut(wanted.select(F.col("cid").alias("id"), "sig"))
    texts = met(docs.select(row_key(doc_id, text).alias("row"), F.col(text).alias("t")), wanted.select(F.col("cid").alias("id"), "row"), "row")
    sets = stored(shingle_sets(texts.groupBy("id").agg(F.first("t").alias("t"))))  # equal rows have equal texts

    def verified(pairs: DataFrame) -> DataFrame:
        side = lambda t, i, c: t.select(F.col("id").alias(i), F.col(t.columns[1]).alias(c))
        likely = cut(bayes(met(met(pairs, side(sigs, "a", "sa"), "a"), side(sigs, "b", "sb"), "b"), tests))
        return cut(exact(met(met(likely, side(sets, "a", "ga"), "a"), side(sets, "b", "gb"), "b"), percent))

    labels, tested = cut(ids.select("id", F.col("id").alias("comp"))), None
    for turn in range(rounds + 1):
        placed = met(members, labels, "id")
        mixed = cut(placed.groupBy("key").agg(F.min("comp").alias("c0"), F.max("comp").alias("c1")).where("c0 < c1").select("key"))
        placed = cut(met(placed, mixed, "key"))
        if placed.isEmpty():
            break
        if turn < rounds:
            one = cut(placed.groupBy("key", "comp").agg(F.expr(f"min_by(id, xxhash64(id, {turn}))").alias("m"), F.count("*").alias("n")))
            lead = cut(one.groupBy("key").agg(F.max(F.struct("n", "comp", F.col("m").alias("lead"))).alias("l")).select("key", F.col("l.comp").alias("lc"), F.col("l.lead").alias("lead")))
            pairs = met(one, lead, "key").where("comp <> lc").select(F.least("m", "lead").alias("a"), F.greatest("m", "lead").alias("b")).distinct()
            pairs = cut(pairs if tested is None else met(pairs, tested, ["a", "b"], "left_anti"))
            tested = pairs if tested is None else tested.unionByName(pairs)
            links = verified(pairs)
        else:
            links = rest(placed, sigs, sets, tests, percent, chunk)
        if links.isEmpty():
            continue
        side = lambda i, c: labels.select(F.col("id").alias(i), F.col("comp").alias(c))
        merged = components(met(met(links, side("a", "ca"), "a"), side("b", "cb"), "b").where("ca <> cb").select("ca", "cb"), "ca", "cb", "root")
        labels = cut(met(labels, merged.withColumnRenamed("id", "comp"), "comp", "left").select("id", F.coalesce("root", "comp").alias("comp")))
    classes = met(every.select("cid", "fp", "rep"), labels.withColumnRenamed("id", "cid"), "cid", "left").select("fp", "rep", F.coalesce("comp", "cid").alias("comp"))
    names = cut(classes.groupBy("comp").agg(F.min("rep").alias("component_id")))
    return feat.select("id", "row", "n_shingles", "fp"), cut(met(classes, names, "comp").select("fp", "comp", "component_id"))


def near_duplicates(docs: DataFrame, percent: int = 85, miss: float = 1e-6, step: int = 20, rounds: int = 2, chunk: int = 1024, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) per row of docs.

    Null texts and texts without words have no shingles and are linked with nothing. Ties don't matter: the least id names the
    component. Repeated rows are one class; an id with several texts has the links of all of them, row by row; a row without an id
    links like any other but never names a component, and is not kept. An empty table gives an empty result; columns besides the
    two are ignored; whole texts of any length count.
    """
    rows, classes = linked(docs, percent, miss, step, rounds, chunk, doc_id, text)
    out = met(rows, classes, "fp", "left").select(F.col("id").alias(doc_id), "n_shingles", F.when(F.col("fp").isNull(), F.col("id")).otherwise(F.col("component_id")).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col(doc_id) == F.col("component_id"), F.lit(False)))


def deduplicated(docs: DataFrame, percent: int = 85, miss: float = 1e-6, step: int = 20, rounds: int = 2, chunk: int = 1024, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with one row of each component: that with the least id, of equal ids the one with the least digest, without an id last.

    Of rows with equal id and text one stays, whichever. Rows without words are no one's duplicates and stay, repeated or not. All
    columns stay; those named like the two are read by name, whatever else the table holds. An empty table stays empty.
    """
    rows, classes = linked(docs, percent, miss, step, rounds, chunk, doc_id, text)
    key, n = unused(docs, "_row"), unused(docs, "_n")
    same = rows.where("fp IS NOT NULL").groupBy("fp", "row").agg(F.min("id").alias("id"), F.count("*").alias("n"))
    first = F.min(F.struct(F.col("id").isNull().alias("none"), F.col("id"), F.col("row"), F.col("n")))
    stay = cut(met(same, classes, "fp").groupBy("comp").agg(first.alias("f")).select(F.col("f.row").alias(key), F.col("f.n").alias(n)))
    keyed = docs.withColumn(key, row_key(doc_id, text))
    worded = F.coalesce(F.rlike(F.col(text), F.lit(WORD)), F.lit(False))
    one = met(keyed.where(worded), stay.where(F.col(n) == 1), key, "left_semi")
    several = met(keyed.where(worded), stay.where(F.col(n) > 1), key, "left_semi").dropDuplicates([key])
    return docs.where(~worded).unionByName(one.drop(key)).unionByName(several.drop(key))


def op6_minhash_bayes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
