"""Label mining and the classification cascade."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.functions.scalar import clean_code, norm_title, valid_fein
from lodestar.sources.scratch import stored

from .linkage import Encoder, embed, nearest_vectors
from .rollups import pair_consensus
from .upsert import apply_patch


def _mined(records: DataFrame) -> DataFrame:
    return records.select(norm_title(F.col("job_title")).alias("title"), clean_code(F.col("filed_soc_code")).alias("code"), F.col("filed_soc_title").alias("label"), "employer_fein", "employer_name").where("title IS NOT NULL AND code IS NOT NULL")


def bootstrap_aliases(records: DataFrame, aliases: DataFrame, min_hits: int = 5, min_employers: int = 2, min_agreement: float = 0.8) -> DataFrame:
    """Titles on whose code several employers agree and that the dictionary lacks."""
    # Known titles go first: no other title's agreement depends on them, and they needn't be counted.
    known = aliases.select(F.lower("job_title").alias("title"))
    rows = stored(_mined(records).join(known, "title", "left_anti").drop("employer_fein"))
    got = pair_consensus(rows, ["title"], "code", "label", min_hits, min_agreement, "employer_name", min_employers)
    return got.select("title", "code", "label", "hits", F.col("distinct_n").alias("employers"), F.lit("bootstrap").alias("source"))


def refresh_consensus(records: DataFrame, min_hits: int = 5, min_agreement: float = 0.8) -> DataFrame:
    """The code that an employer gives a title, where it mostly gives the same."""
    rows = _mined(records).where(valid_fein(F.col("employer_fein"), strict=False))
    got = pair_consensus(rows, ["employer_fein", "title"], "code", "label", min_hits, min_agreement)
    return got.select("employer_fein", "title", "code", "label", "hits", "agreement")


def grouped_split(rows: DataFrame, group: str, percent: int = 20, seed: int = 0) -> DataFrame:
    """Whole groups to test; no group is on both sides."""
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(group)).cast("binary"))
    return rows.withColumn("is_test", F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") % 100 < percent)


def clip_labels(split: DataFrame, label: str) -> DataFrame:
    """The split without test rows whose label no training row has."""
    seen = split.where("NOT is_test").select(F.col(label).alias("_seen")).distinct()
    return split.where("NOT is_test").unionByName(split.where("is_test").join(seen, F.col(label) == F.col("_seen"), "left_semi"))


def evaluate_labels(pairs: DataFrame, pred: str, gold: str) -> DataFrame:
    hit = lambda c: F.sum(F.coalesce(c, F.lit(False)).cast("long"))
    return pairs.agg(F.count("*").alias("n"), hit(F.col(pred) == F.col(gold)).alias("exact"), hit(F.substring(pred, 1, 2) == F.substring(gold, 1, 2)).alias("major"))


def topk_candidates(titles: DataFrame, aliases: DataFrame, k: int = 10, encoder: Encoder | None = None) -> DataFrame:
    """(job_title, rank, code, sim): for each distinct non-blank title the k best codes by cosine of its nearest alias, each code once."""
    encode = encoder or embed
    q = encode(titles.select("job_title").where("trim(job_title) <> ''").distinct(), "job_title").select(F.col("job_title").alias("id"), "v")
    b = encode(aliases.select("job_title", "soc_code"), "job_title").select(F.col("job_title").alias("id"), "v", "soc_code")
    near = nearest_vectors(q, b, k, digits=4, label="soc_code")
    return near.select(F.col("query_id").alias("job_title"), "rank", F.col("label").alias("code"), "sim")


def semantic_nearest(titles: DataFrame, aliases: DataFrame, encoder: Encoder | None = None) -> DataFrame:
    """(job_title, code, sim): the code of each distinct title's nearest alias."""
    return topk_candidates(titles, aliases, 1, encoder).drop("rank")


def classify(records: DataFrame, consensus: DataFrame, aliases: DataFrame, nearest: DataFrame | None = None) -> DataFrame:
    """Stage 0 consensus of the employer, stage 1 dictionary, stage 2 nearest (job_title, code, sim): the first hit wins.

    Blank titles get 00-0000 with confidence 0. The title is trimmed for stage 0 only.
    """
    c = consensus.select(F.col("employer_fein").alias("_f"), F.col("title").alias("_t0"), F.col("code").alias("_c0"), F.least(F.lit(0.99), F.col("agreement")).alias("_k0"))
    a = aliases.groupBy(F.lower("job_title").alias("_t1")).agg(F.min("soc_code").alias("_c1"))
    t = F.col("job_title")
    out = records.join(c, (F.col("employer_fein") == F.col("_f")) & (F.lower(F.trim(t)) == F.col("_t0")), "left").join(a, F.lower(t) == F.col("_t1"), "left")
    stages: list[tuple[Column, Column, Column, str]] = [
        (F.trim(F.coalesce(t, F.lit(""))) == "", F.lit("00-0000"), F.lit(0.0), "blank"),
        (F.col("_c0").isNotNull(), F.col("_c0"), F.col("_k0"), "employer_consensus"),
        (F.col("_c1").isNotNull(), F.col("_c1"), F.lit(1.0), "dmtf"),
    ]
    if nearest is not None:
        out = out.join(nearest.select(F.col("job_title").alias("_t2"), F.col("code").alias("_c2"), F.col("sim").alias("_k2")), t == F.col("_t2"), "left")
        stages.append((F.col("_c2").isNotNull(), F.col("_c2"), F.col("_k2"), "stage2"))
    code, conf, source = F.lit(None).cast("string"), F.lit(0.0), F.lit(None).cast("string")
    for test, k, s, name in reversed(stages):
        code, conf, source = F.when(test, k).otherwise(code), F.when(test, s).otherwise(conf), F.when(test, name).otherwise(source)
    out = out.withColumns({"pred_code": code, "pred_confidence": conf, "pred_source": source})
    return out.drop("_f", "_t0", "_c0", "_k0", "_t1", "_c1", "_t2", "_c2", "_k2")


def confidence_gate(rows: DataFrame, confidence: str, threshold: float = 0.7) -> tuple[DataFrame, DataFrame]:
    """(classified, quarantined); a missing confidence is quarantined, the threshold itself passes."""
    low = F.coalesce(F.col(confidence) < threshold, F.lit(True))
    error = F.struct(F.lit("low_soc_confidence").alias("type"), F.col(confidence).alias("soc_confidence"))
    return rows.where(~low), rows.where(low).withColumn("errors", error)


def parse_answers(said: DataFrame, key: str, raw: str = "raw") -> DataFrame:
    """(key, choice, confident, reason) of raw answers: the whole text as JSON, else its first {…}; choice 0 where neither is any.

    A missing choice is 0, a missing confidence is false.
    """
    text = F.trim(F.col(raw))
    part = F.regexp_extract(text, r"(?s)\{[^{}]*\}", 0)
    doc = F.when(F.try_parse_json(text).isNotNull(), text).when(F.try_parse_json(part).isNotNull(), part)
    field = lambda k: F.get_json_object(F.col("_d"), f"$.{k}")
    sure = ~F.lower(field("confident")).isin("false", "0", "")
    choice = F.coalesce(field("choice").try_cast("double").cast("int"), F.lit(0))
    return said.select(key, doc.alias("_d")).select(key, choice.alias("choice"), F.coalesce(sure, F.lit(False)).alias("confident"), F.substring(F.coalesce(field("reason"), F.lit("")), 1, 200).alias("reason"))


def write_back(records: DataFrame, quarantine: DataFrame, decided: DataFrame, key: str, source: str = "llm") -> tuple[DataFrame, DataFrame]:
    """(records, quarantine) after adjudicate(): records take the codes of resolved rows, which leave the quarantine."""
    got = decided.where("resolved")
    patch = got.select(key, F.col("code").alias("soc_code"), F.lit(source).alias("soc_source"), "review_reason", F.col("review_reason").isNotNull().alias("requires_review"))
    return apply_patch(records, patch, [key]), quarantine.join(got, key, "left_anti")


def adjudicate(quarantine: DataFrame, candidates: DataFrame, key: str, picker: Callable | None = None, short_len: int = 12) -> DataFrame:
    """One decision per quarantined row over its ranked candidates (key, rank, code, sim).

    picker maps batches of (key, job_title, codes, sims) to (key, choice, confident) through mapInPandas; without one the best
    candidate is chosen. Choice 0 or one out of range leaves the row in quarantine; short titles are only flagged for review.
    """
    ranked = candidates.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("rank", "code", "sim"))).alias("c"))
    rows = quarantine.select(key, "job_title").join(ranked, key, "left").select(key, "job_title", F.coalesce(F.col("c.code"), F.array().cast("array<string>")).alias("codes"), F.coalesce(F.col("c.sim"), F.array().cast("array<double>")).alias("sims"))
    if picker is None:
        chosen = rows.withColumn("choice", F.when(F.size("codes") > 0, 1).otherwise(0)).withColumn("confident", F.lit(True))
    else:
        said = rows.mapInPandas(picker, f"{key} {dict(rows.dtypes)[key]}, choice int, confident boolean")
        chosen = rows.join(said, key, "left")
    good = F.col("choice").between(1, F.size("codes")) & F.col("confident")
    short = F.length("job_title") < short_len
    return chosen.select(key, F.when(good, F.get("codes", F.col("choice") - 1)).alias("code"), F.when(good & short, "short_title_pick").alias("review_reason"), F.coalesce(good, F.lit(False)).alias("resolved"))
