"""A training-data pipeline over `documents`: quality rules, near-duplicates, secrets, mixing, tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.llm import minhash, mixing, quality, secrets, spm
from lodestar.llm.common import stored

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep; each row is judged by its own text, whatever its id.

    Null and empty texts have too few words and go; a text of any length is judged whole; repeated rows are judged alike; a score
    at the threshold is kept; an empty table stays empty. Columns besides those of documents are left out.
    """
    return quality.rules(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), carry=tuple(COLUMNS[1:])).where("kept").select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the one with the least id, of equal rows one.

    A pair counts from a similarity of 0.85 on, as in op6; near copies from 0.8 up to that stay. Rows without words (null and empty
    texts) all stay; a row without an id stays only if no row of its group has one. An id with several texts is several documents.
    Whole texts of any length count; an empty table stays empty. Columns besides those of documents are left out.
    """
    return minhash.deduplicated(docs.select(*COLUMNS))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents; the spans that the scan finds are replaced by a mark.

    Overlapping spans become one mark. Null, empty and clean texts stay as they are, repeated rows stay repeated, texts of any
    length are scanned whole, an empty table stays empty. Columns besides those of documents are left out.
    """
    return secrets.redacted(docs.select(*COLUMNS)).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix draws it.

    Null sources are one source, the last. A null or empty text has no words and is drawn like the smallest; repeated rows are drawn
    each on its own; no row is drawn more than twice; an empty table stays empty. Columns besides those of documents are left out.
    """
    return mixing.emit(mixing.mix(docs.select(*COLUMNS)), COLUMNS)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, one row for each, repeated or not.

    A null text is the empty one and has the end id only; texts of any length are encoded whole; an empty table gives an empty
    result; other columns than doc_id and text are ignored.
    """
    return spm.encode_texts(docs, spm.default_model(), keep_ids=True)


STAGES = [
    ("quality rules", quality_rules),
    ("minhash near-dedup", near_dedup),
    ("secret scans", secret_scan),
    ("mixing", mix_sources),
    ("sentencepiece", tokenize),
]
#: The quality score, the signatures and the tokens are not SQL; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(docs)
    return docs
