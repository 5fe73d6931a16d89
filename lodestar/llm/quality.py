"""Quality rules: base counts of a text, and a hashed n-gram log-likelihood ratio between trusted and raw multinomials."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, cut, stored, table

BUCKETS = 1 << 15
#: n-gram lengths in UTF-8 bytes.
ORDERS = (2, 4)
SYMBOLS = b"#*$%&|<>"
SPACES = b"\t\n\v\f\r "


def hashed(text: bytes) -> np.ndarray:
    """Buckets of all byte n-grams of a text, in no particular order."""
    codes = np.frombuffer(text, np.uint8).astype(np.uint32)
    out = []
    for n in ORDERS:
        if len(codes) >= n:
            h = np.full(len(codes) - n + 1, n, np.uint32)
            for k in range(n):
                h *= np.uint32(0x01000193)
                h ^= codes[k : len(codes) - n + 1 + k]
            h *= np.uint32(0x9E3779B1)
            out.append(h >> np.uint32(32 - 15))
    return np.concatenate(out) if out else np.empty(0, np.uint32)


def repeated_words(words: list[bytes], size: int = 8) -> int:
    """Words inside windows of `size` words that occur twice or more in the text."""
    n = len(words)
    if n <= size:
        return 0
    ids: dict[bytes, int] = {}
    rank = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, n)
    mixed = rank.astype(np.uint64)
    mixed = (mixed + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(29)
    h = np.zeros(n - size + 1, np.uint64)
    for k in range(size):
        h = h * np.uint64(0xD6E8FEB86659FD93) + mixed[k : n - size + 1 + k]
    if len(np.unique(h)) == len(h):
        return 0
    width = 1  # exact: windows of 2, 4 and 8 words by the ranks of their halves
    while width < size:
        pairs = rank[:-width] * (int(rank.max()) + 1) + rank[width:]
        rank = np.unique(pairs, return_inverse=True)[1].astype(np.int64)
        width *= 2
    twice = np.bincount(rank)[rank] > 1
    steps = np.zeros(n + 1, np.int64)
    starts = np.flatnonzero(twice)
    np.add.at(steps, starts, 1)
    np.add.at(steps, starts + size, -1)
    return int((np.cumsum(steps[:n]) > 0).sum())


def base_counts(text: str) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    raw = text.encode("utf-8", "replace")
    words = raw.split()
    white = sum(raw.count(SPACES[k : k + 1]) for k in range(6))
    symbols = sum(raw.count(SYMBOLS[k : k + 1]) for k in range(8))
    lines = [x for x in raw.split(b"\n") if x and not x.isspace()]
    return len(words), len(text) - white, symbols, len(lines) - len(set(lines)), repeated_words(words)


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(BUCKETS, np.int64)
    for batch in batches:
        for t in batch.column(0).to_pylist():
            if t:
                total += np.bincount(hashed(t.encode("utf-8", "replace")), minlength=BUCKETS)
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["bucket", "n"])


def bucket_counts(texts: DataFrame) -> np.ndarray:
    """n-grams of all texts by bucket; BUCKETS sums return, however many texts there are."""
    out = np.zeros(BUCKETS)
    for r in texts.select("text").mapInArrow(_counts, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r["bucket"]] = r["n"]
    return out


def _scored(ratio: np.ndarray, carry: tuple[str, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    fields = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "score", *carry]
    for batch in batches:
        rows = []
        for t in batch.column(1).to_pylist():
            h = hashed((t or "").encode("utf-8", "replace"))
            rows.append((*base_counts(t or ""), round(float(ratio[h].mean()), 6) if len(h) else 0.0))
        cols = list(zip(*rows, strict=True)) or [()] * 6
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in cols[:5]), pa.array(cols[5], pa.float64()), *(batch.column(c) for c in carry)], fields)


def labelled_kinds(labels: DataFrame) -> DataFrame:
    """(doc_id, kind) of all labelled ids: 1 trusted (good and not toxic), 0 bad, 2 other.

    Rows with a null id or quality are left out; a doc_id with several labels is trusted only if all are.
    """
    kind = F.when(F.col("quality") == 0, 0).when(F.coalesce("toxic", F.lit(0)) == 0, 1).otherwise(2)
    rows = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(F.min(kind).alias("kind"), F.max(kind).alias("top"))
    return rows.select("doc_id", F.when((F.col("kind") == 1) & (F.col("top") == 2), 2).otherwise(F.col("kind")).alias("kind"))


#: Bits of the labelled ids: 8 MB however many there are; with more of them more rows pass, and the join by id decides in any case.
ID_BITS = 26


def maybe_labelled(texts: DataFrame, kinds: DataFrame) -> DataFrame:
    """The rows of texts whose doc_id may be one of kinds: all that are, and few others, so that those needn't be shuffled."""
    if dict(texts.dtypes)["doc_id"] != dict(kinds.dtypes)["doc_id"]:
        return texts  # ids of unlike types have unlike hashes
    spot, low = F.pmod(F.xxhash64("doc_id"), F.lit(1 << ID_BITS)), F.lit(32767).cast("long")
    bits = kinds.groupBy(F.shiftright(spot, 15).alias("_part")).agg(F.bitmap_construct_agg(spot.bitwiseAND(low)).alias("_bits"))
    at = spot.bitwiseAND(low)
    byte = F.conv(F.hex(F.substring("_bits", (F.shiftright(at, 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    mark = F.call_function("getbit", byte, at.bitwiseAND(F.lit(7).cast("long")).cast("int"))
    return texts.join(F.broadcast(bits), F.shiftright(spot, 15) == F.col("_part")).where(mark == 1).select(*texts.columns)


class Tally:
    """Scores as rising values and how often each occurs; its length is the number of scores."""

    def __init__(self, values: np.ndarray, counts: np.ndarray):
        self.values, self.ends = np.asarray(values, float), np.cumsum(np.asarray(counts, np.int64))

    def __len__(self) -> int:
        return int(self.ends[-1]) if len(self.ends) else 0

    def min(self) -> float:
        return float(self.values[0])

    def neighbours(self, q: float) -> tuple[int, int, float]:
        """Where the two values around a quantile stand in values, and the place between them."""
        at = (len(self) - 1) * q
        low = int(at)
        places = np.searchsorted(self.ends, [low, min(low + 1, len(self) - 1)], "right")
        return int(places[0]), int(places[1]), at - low

    def quantile(self, q: float) -> float:
        a, b, between = self.neighbours(q)
        return float(np.quantile(self.values[[a, b]], between))

    def at_least(self, cuts: np.ndarray) -> np.ndarray:
        return len(self) - np.concatenate([[0], self.ends])[np.searchsorted(self.values, cuts, "left")]


def fit_threshold(good: np.ndarray | Tally, bad: np.ndarray | Tally, keep: float) -> float:
    """The threshold in thousandths that lets the fewest bad texts pass among those that keep at least `keep` of the good ones;
    of equals the middle one. Without good texts nothing is rejected, without bad ones only what lies below all good ones."""
    good, bad = (x if isinstance(x, Tally) else Tally(*np.unique(x, return_counts=True)) for x in (good, bad))
    if not len(good):
        return float("-inf")
    top = good.quantile(1 - keep)
    low = min(good.min(), bad.min() if len(bad) else good.min())
    cuts = np.arange(np.floor(low * 1000), np.floor(top * 1000) + 1) / 1000
    if not len(bad):
        return float(min(good.min(), cuts[-1]))
    passed = bad.at_least(cuts)
    best = cuts[passed == passed.min()]
    return float(best[len(best) // 2])


def tallies(scores: DataFrame, keep: float) -> tuple[Tally, Tally]:
    """What fit_threshold needs of all (kind, score), good and bad, scores with six digits.

    The driver gets a row for each kind and thousandth, and the scores of those two thousandths that the quantile lies in: at most a
    thousand each. Others stand for theirs with the least score, which changes no comparison with a thousandth.
    """
    bins = scores.groupBy("kind", F.floor(F.round(F.col("score") * 1_000_000) / 1000).alias("bin")).agg(F.count("*").alias("n"), F.min("score").alias("least"))
    rows = sorted(bins.collect())
    of = lambda k: Tally(np.array([r["least"] for r in rows if r["kind"] == k]), np.array([r["n"] for r in rows if r["kind"] == k]))
    good, bad = of(1), of(0)
    if not len(good):
        return good, bad
    mine = [r for r in rows if r["kind"] == 1]
    held = {mine[k]["bin"] for k in good.neighbours(1 - keep)[:2]}
    some = scores.where("kind = 1").where(F.floor(F.round(F.col("score") * 1_000_000) / 1000).isin(*held)).groupBy("score").agg(F.count("*").alias("n")).collect()
    every = sorted([(r["least"], r["n"]) for r in mine if r["bin"] not in held] + [(r["score"], r["n"]) for r in some])
    return Tally(np.array([v for v, _ in every]), np.array([n for _, n in every])), bad


RESULTS = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "score", "base_failed", "threshold", "kept"]


def rules(docs: DataFrame, labels: DataFrame, prior: float = 1e5, keep: float = 0.998, carry: tuple[str, ...] = ()) -> DataFrame:
    """Base counts, score and verdict of every document.

    Raw counts cover all texts; the trusted multinomial comes from all good, non-toxic labelled documents (smoothed towards the raw
    one with `prior` pseudo-counts), and the threshold from the scores of all labelled ones, one text of each id. The score is the mean log ratio over the n-grams of the whole text. A null or empty text has no words, so it fails the base; repeated
    rows are judged alike; columns besides doc_id and text are ignored, but those in `carry` go along with their row, so that the
    verdict needs no join by id; one that is named like a result gives way to it. Without labels every text that passes the base is kept.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    carry = tuple(c for c in carry if c not in RESULTS)
    texts = docs.select("doc_id", "text")
    # Read for the counts and for the threshold. One kind of join at all sizes: few labels would be broadcast, many not.
    kinds = labelled_kinds(labels).where("kind <> 2")
    labelled = stored(maybe_labelled(texts, kinds).join(kinds.hint("merge"), "doc_id").select("doc_id", "text", "kind"))
    raw, trusted = 1 + bucket_counts(texts), bucket_counts(labelled.where("kind = 1"))
    p = raw / raw.sum()
    ratio = np.log((trusted + prior * p) / (trusted.sum() + prior)) - np.log(p)
    table_ = spark.sparkContext.broadcast(ratio)
    fields = "doc_id {}, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, score double".format(dict(docs.dtypes)["doc_id"])
    score = lambda df, along=(): df.mapInArrow(lambda it: _scored(table_.value, along, it), ", ".join([fields, *(f"`{c}` {dict(df.dtypes)[c]}" for c in along)]))
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    known = labelled.withColumn("hash", F.xxhash64("text"))
    # Of several texts of one id the one of the least hash counts.
    one = score(known, ("kind", "hash")).groupBy("doc_id").agg(F.min_by(F.struct("kind", "score", failed.alias("failed")), F.col("hash")).alias("s"))
    threshold = fit_threshold(*tallies(cut(one.where("NOT s.failed").select("s.kind", "s.score")), keep), keep)
    out = score(docs.select("doc_id", "text", *(c for c in carry if c != "text")), carry).withColumn("base_failed", failed)
    return out.withColumn("threshold", F.lit(threshold)).withColumn("kept", ~F.col("base_failed") & (F.col("score") >= F.col("threshold")))


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
