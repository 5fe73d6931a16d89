"""Language identification: multinomial naive Bayes over hashed character n-grams."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, cut, table

BITS = 14
BUCKETS = 1 << BITS
ORDERS = (1, 2, 3)
LETTER = re.compile("[A-Za-z]")
#: Numbers that one product of a batch holds at most: n-grams of its texts times languages.
CELLS = 1 << 22


def has_letter(text: str) -> bool:
    """Whether a character is a letter (general category L)."""
    return LETTER.search(text) is not None or any(map(str.isalpha, text))


def hashed(text: str) -> np.ndarray:
    """Buckets of all character n-grams of the lower-cased text."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    out = []
    for n in ORDERS:
        if len(codes) >= n:
            h = np.full(len(codes) - n + 1, n, np.uint32)
            for k in range(n):
                h *= np.uint32(0x85EBCA6B)
                h ^= codes[k : len(codes) - n + 1 + k]
            h *= np.uint32(0x9E3779B1)
            out.append(h >> np.uint32(32 - BITS))
    return np.concatenate(out) if out else np.empty(0, np.uint32)


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, bucket, n) of a partition; bucket -1 counts the documents."""
    seen: dict[str, np.ndarray] = {}
    docs: dict[str, int] = {}
    for batch in batches:
        for t, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if lang not in seen:
                seen[lang], docs[lang] = np.zeros(BUCKETS, np.int64), 0
            seen[lang] += np.bincount(hashed(t), minlength=BUCKETS)
            docs[lang] += 1
    for lang, c in seen.items():
        at = np.flatnonzero(c)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * (len(at) + 1), pa.string()), pa.array([-1, *at.tolist()], pa.int64()), pa.array([docs[lang], *c[at].tolist()], pa.int64())], ["lang", "bucket", "n"])


def fit(rows: DataFrame, max_langs: int = 1000, alpha: float = 0.5) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Languages in order, log priors, and log probabilities (buckets x languages) from all rows of (text, lang).

    The model has max_langs x BUCKETS numbers at most; a table with more languages than that is refused.
    """
    totals = cut(rows.mapInArrow(_counts, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")))
    many = totals.where("bucket < 0").count()
    if many > max_langs:  # before anything is collected
        raise ValueError(f"{many} languages; at most {max_langs} are supported")
    counts = totals.toPandas()
    langs = sorted(counts["lang"].unique())
    code = {x: k for k, x in enumerate(langs)}
    matrix, docs = np.full((BUCKETS, len(langs)), alpha), np.zeros(len(langs))
    column = counts["lang"].map(code).to_numpy(dtype=np.int64)
    bucket, n = counts["bucket"].to_numpy(), counts["n"].to_numpy()
    whole = bucket < 0
    docs[column[whole]] = n[whole]
    matrix[bucket[~whole], column[~whole]] += n[~whole]
    return langs, np.log(docs / docs.sum()) if len(langs) else docs, np.log(matrix / matrix.sum(axis=0))


def batch_scores(texts: list[str], prior: np.ndarray, logs: np.ndarray) -> np.ndarray:
    """Log posteriors (texts x languages) but for a constant: a sparse matrix of texts and buckets times the log probabilities.

    The matrix is held by rows, as the buckets that occur and their counts. Its product is taken for as many texts at once as
    CELLS allows, but for one at least; a text has BUCKETS entries at most, whatever its length.
    """
    out = np.empty((len(texts), len(prior)))
    at: list[np.ndarray] = []
    counts: list[np.ndarray] = []
    first = held = 0

    def flush(end: int) -> None:
        nonlocal first, held
        if at:
            sizes = np.array([len(x) for x in at])
            rows = logs[np.concatenate(at)] * np.concatenate(counts)[:, None]
            starts = np.cumsum(sizes) - sizes
            full = sizes > 0  # reduceat takes no empty row
            sums = np.zeros((len(at), len(prior)))
            if full.any():
                sums[full] = np.add.reduceat(rows, starts[full], axis=0)
            out[first:end] = prior + sums
        at.clear()
        counts.clear()
        first, held = end, 0

    for k, t in enumerate(texts):
        c = np.bincount(hashed(t), minlength=BUCKETS)
        x = np.flatnonzero(c)
        if held and (held + len(x)) * len(prior) > CELLS:
            flush(k)
        at.append(x)
        counts.append(c[x].astype(np.float64))
        held += len(x)
    flush(len(texts))
    return out


def _predict(model: tuple[list[str], np.ndarray, np.ndarray], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    langs, prior, logs = model
    for batch in batches:
        texts = batch.column(1).to_pylist()
        asked = [k for k, t in enumerate(texts) if langs and t is not None and has_letter(t)]
        names, scores = ["und"] * len(texts), [0.0] * len(texts)
        if asked:
            s = batch_scores([texts[k] for k in asked], prior, logs)
            best = s.argmax(axis=1)
            post = 1 / np.exp(s - s.max(axis=1)[:, None]).sum(axis=1)
            for k, b, p in zip(asked, best.tolist(), post.tolist(), strict=True):
                names[k], scores[k] = langs[b], round(p, 6)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "lang_pred", "score"])


def identify(train: DataFrame, docs: DataFrame) -> DataFrame:
    """(doc_id, lang_pred, score) for every row of docs, by a model of train's text and lang (null in either: left out).

    lang_pred is one of the learned values, the first by code point of equally probable ones; und with score 0 if the text is
    null or has no letter, or nothing was learned. score is the posterior probability. Repeated rows and extra columns change
    nothing; texts of any length are read whole; an empty table gives an empty result.
    """
    bounded_batches(docs.sparkSession)
    model = docs.sparkSession.sparkContext.broadcast(fit(train.where("text IS NOT NULL AND lang IS NOT NULL").select("text", "lang")))
    return docs.select("doc_id", "text").mapInArrow(lambda it: _predict(model.value, it), f"doc_id {dict(docs.dtypes)['doc_id']}, lang_pred string, score double")


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    # A null id counts as the empty text, whose remainder is 0: nothing is learned from it.
    held = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5 == 0
    out = identify(docs.where(~held), docs)
    return out.select("doc_id", held.alias("held_out"), "lang_pred", "score")
