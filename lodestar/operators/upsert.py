"""Upserts, patches and review decisions as set operations on frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def upsert(target: DataFrame, source: DataFrame, keys: list[str], policy: str = "update", counters: tuple[str, ...] = ()) -> DataFrame:
    """Rows of both by key. policy: nothing keeps the target's values, update takes the source's where it has one; counters add up."""
    cols = [c for c in target.columns if c not in keys]
    t = target.select(*keys, *[F.col(c).alias(f"_t_{c}") for c in cols], F.lit(True).alias("_t"))
    s = source.select(*keys, *[F.col(c).alias(f"_s_{c}") for c in cols if c in source.columns])
    out = []
    for c in cols:
        new = F.col(f"_s_{c}") if c in source.columns else F.lit(None)
        old = F.col(f"_t_{c}")
        if c in counters:
            value = F.coalesce(old, F.lit(0)) + F.coalesce(new, F.lit(0))
        else:
            value = F.coalesce(new, old) if policy == "update" else F.when(F.col("_t"), old).otherwise(new)
        out.append(value.alias(c))
    return t.join(s, keys, "full_outer").select(*keys, *out)


def apply_patch(records: DataFrame, patches: DataFrame, keys: list[str]) -> DataFrame:
    """Records with the patch's values where the patch has the row; nulls in a patch are values."""
    cols = [c for c in patches.columns if c not in keys]
    p = patches.select(*keys, *[F.col(c).alias(f"_p_{c}") for c in cols], F.lit(True).alias("_p"))
    new = {c: F.when(F.col("_p"), F.col(f"_p_{c}")).otherwise(F.col(c) if c in records.columns else F.lit(None)) for c in cols}
    return records.join(p, keys, "left").withColumns(new).drop("_p", *[f"_p_{c}" for c in cols])


def latest(decisions: DataFrame, keys: list[str]) -> DataFrame:
    """Of several decisions on a row the latest, of equally late ones the one with the greatest id."""
    w = Window.partitionBy(*keys).orderBy(F.desc("decided_at"), F.desc("decision_id"))
    return decisions.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")


def review_decisions(records: DataFrame, decisions: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(records, newly quarantined): accept clears the flag, override sets code, confidence 1 and source operator, reject nulls the code."""
    d = latest(decisions, [key]).select(key, F.col("action").alias("_a"), F.col("code").alias("_c"))
    j = records.join(d, key, "left")
    over, reject = F.col("_a") == "override", F.col("_a") == "reject"
    out = j.withColumns({
        "soc_code": F.when(over, F.col("_c")).when(reject, F.lit(None)).otherwise(F.col("soc_code")),
        "soc_confidence": F.when(over, 1.0).when(reject, F.lit(None)).otherwise(F.col("soc_confidence")),
        "soc_source": F.when(over, "operator").when(reject, F.lit(None)).otherwise(F.col("soc_source")),
        "requires_review": F.when(F.col("_a").isNotNull(), False).otherwise(F.col("requires_review")),
    })
    gone = out.where(F.coalesce(reject, F.lit(False))).select(key, F.lit("operator_reject").alias("error"))
    return out.drop("_a", "_c"), gone


def quarantine_decisions(quarantine: DataFrame, records: DataFrame, decisions: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """(records, quarantine) after a log of decisions on open rows of the quarantine (id, the record's keys, reprocessed_at).

    decisions: decision_id, id, action, code, note, decided_at; the latest on a row counts. assign writes the code to the row's
    record, if it is there, with confidence 1 and source operator; drop writes nothing. Both close the row and leave an audit: the
    action, the code, the note and whether a record was found. Rows that are closed already stay as they are.
    """
    d = latest(decisions, ["id"]).select("id", F.col("action").alias("_a"), F.col("code").alias("_c"), F.col("note").alias("_n"), F.col("decided_at").alias("_at"))
    d = d.where(F.col("_a").isin("assign", "drop"))
    open_ = quarantine.where("reprocessed_at IS NULL").select("id", *keys).join(d, "id")
    found = open_.join(records.select(*keys).distinct().withColumn("_f", F.lit(True)), keys, "left")
    order = Window.partitionBy(*keys).orderBy(F.desc("_at"), F.desc("id"))  # of several rows on one record the latest writes
    # A patch for a record that isn't there changes nothing, so it needs no look at the records.
    assigned = open_.where("_a = 'assign'").withColumn("_k", F.row_number().over(order)).where("_k = 1")
    patch = assigned.select(*keys, F.col("_c").alias("soc_code"), F.lit(1.0).alias("soc_confidence"), F.lit("operator").alias("soc_source"), F.lit(False).alias("requires_review"))
    audit = F.struct(F.when(F.col("_a") == "assign", "assigned").otherwise("dropped").alias("action"), F.col("_c").alias("code"), F.col("_n").alias("note"), ((F.col("_a") == "assign") & F.coalesce("_f", F.lit(False))).alias("record_found"))
    closed = found.select("id", F.col("_at"), audit.alias("_audit"))
    out = quarantine.join(closed, "id", "left").withColumns({"reprocessed_at": F.coalesce("reprocessed_at", "_at"), "audit": F.col("_audit")}).drop("_at", "_audit")
    return apply_patch(records, patch, keys), out


def review_page(records: DataFrame, key: str, where: str, order: list[str | Column], page: int = 1, limit: int = 50) -> DataFrame:
    """A page of the rows to look at, in a total order; page from 1, limit from 1 to 200."""
    limit = min(200, max(1, limit))
    return records.where(where).orderBy(*order, key).offset((max(1, page) - 1) * limit).limit(limit)
