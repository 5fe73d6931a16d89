"""Rollups over filings. Every ranking has a total order: the metric downwards, then the key."""

from __future__ import annotations

from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestar.functions.scalar import annualize, bucketize, first_number, in_gate, naics2, per_100, valid_state

OUTCOMES = {"certified": "Certified", "denied": "Denied", "withdrawn": "Withdrawn", "certified_withdrawn": "Certified - Withdrawn"}


def waged(f: DataFrame) -> DataFrame:
    """With wage and pw, the annual offered and prevailing wage."""
    wage = annualize(first_number(F.col("wage_rate_of_pay_from")), F.col("wage_unit_of_pay"))
    return f.withColumn("wage", wage).withColumn("pw", annualize(first_number(F.col("prevailing_wage")), F.col("pw_unit_of_pay")))


def count_by(f: DataFrame, *keys: str | Column, out: str = "filings") -> DataFrame:
    return f.groupBy(*keys).agg(F.count("*").alias(out))


def top_n_per_group(df: DataFrame, group: list[str], metric: str, n: int, *ties: str, rank: str | None = None) -> DataFrame:
    w = Window.partitionBy(*group).orderBy(F.desc_nulls_last(metric), *ties)
    out = df.withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") <= n)
    return out.withColumnRenamed("_rank", rank) if rank else out.drop("_rank")


def top_n(df: DataFrame, metric: str, n: int, *ties: str) -> DataFrame:
    return df.orderBy(F.desc_nulls_last(metric), *ties).limit(n)


def global_rank(df: DataFrame, key: str, metric: str, n: int, *ties: str) -> DataFrame:
    """All rows; those of the n keys that lead by metric carry their rank, the tail carries null."""
    top = top_n(df, metric, n, *ties).withColumn("rank", F.row_number().over(Window.orderBy(F.desc_nulls_last(metric), *ties)))
    return df.join(top.select(key, "rank"), key, "left")


def share_of(df: DataFrame, group: list[str], metric: str, out: str) -> DataFrame:
    return df.withColumn(out, per_100(F.col(metric), F.sum(metric).over(Window.partitionBy(*group))))


def or_other(f: DataFrame, key: str, top: DataFrame, other: str, out: str) -> DataFrame:
    """key where it is among the keys of top, a few rows by construction, and other elsewhere."""
    t = F.broadcast(top.select(F.col(key).alias("_k")))
    return f.join(t, F.col(key) == F.col("_k"), "left").withColumn(out, F.coalesce("_k", F.lit(other))).drop("_k")


def quantiles(rows: DataFrame, keys: list[str], value: str, ps: tuple[float, ...] = (0.25, 0.5, 0.75), fine: int = 256) -> DataFrame:
    """keys, n, q (interpolated quantiles), lo and hi of the values that aren't null: exact, by prefix sums on two levels.

    Equal values of a group are counted before the shuffle. Their counts are summed by ranges of the value, `fine` for each factor of e,
    and a running sum over a group's ranges tells which ranges hold a neighbour of a quantile. Only the values in these are put in
    order, each range by itself: no task orders all values of a group, however many there are.
    """
    # Nulls count 0 and go by that: a filter on the value itself would be pushed below the count and evaluate it once more there.
    counts = rows.groupBy(*keys, value).agg(F.count(value).alias("_c")).where("_c > 0")
    v = F.col(value).cast("double")
    counts = counts.withColumn("_b", F.when(v >= 0, F.floor(F.log1p(v) * fine)).otherwise(-1 - F.floor(F.log1p(-v) * fine)))
    group = Window.partitionBy(*keys)
    ranges = counts.groupBy(*keys, "_b").agg(F.sum("_c").alias("_m"), F.min(value).alias("lo"), F.max(value).alias("hi"))
    upto = F.sum("_m").over(group.orderBy("_b").rowsBetween(Window.unboundedPreceding, 0))
    ranges = ranges.select(*keys, "_b", "_m", (upto - F.col("_m")).alias("_before"), F.sum("_m").over(group).alias("_n"), F.min("lo").over(group).alias("lo"), F.max("hi").over(group).alias("hi"))
    place = [(F.col("_n") - 1) * F.lit(p) for p in ps]
    held = lambda k: (F.col("_before") <= k) & (k < F.col("_before") + F.col("_m"))
    wanted = ranges.where(reduce(or_, [held(F.floor(w)) | held(F.ceil(w)) for w in place]))
    same = reduce(and_, [F.col(f"_k_{c}").eqNullSafe(F.col(c)) for c in (*keys, "_b")])
    near = wanted.select(*[F.col(c).alias(f"_k_{c}") for c in (*keys, "_b")], "_before", "_n", "lo", "hi").join(counts, same)
    upto = F.col("_before") + F.sum("_c").over(Window.partitionBy(*keys, "_b").orderBy(value).rowsBetween(Window.unboundedPreceding, 0))
    at = lambda k: F.max(F.when((F.col("_to") - F.col("_c") <= k) & (k < F.col("_to")), F.col(value)))
    neighbours = [x for k, w in enumerate(place) for x in (at(F.floor(w)).alias(f"_lo{k}"), at(F.ceil(w)).alias(f"_hi{k}"))]
    out = near.withColumn("_to", upto).groupBy(*keys).agg(F.first("_n").alias("_n"), *neighbours, F.first("lo").alias("lo"), F.first("hi").alias("hi"))
    part = [w - F.floor(w) for w in place]
    q = [F.when(F.col(f"_lo{k}") == F.col(f"_hi{k}"), F.col(f"_lo{k}")).otherwise((1 - d) * F.col(f"_lo{k}") + d * F.col(f"_hi{k}")) for k, d in enumerate(part)]
    return out.select(*keys, F.col("_n").alias("n"), F.array(*q).alias("q"), "lo", "hi")


def wage_stats(w: DataFrame, *keys: str, value: str = "wage", method: str = "exact") -> DataFrame:
    """n, p25, p50, p75, min and max of the wages inside the gate; percentiles interpolated and rounded half to even."""
    # The bound variable makes the wage, parsed from text, be evaluated once for both bounds and the result.
    rows = w.select(*keys, F.transform(F.array(value), lambda a: F.when(in_gate(a), a))[0].alias(value))
    if method == "exact":
        out = quantiles(rows, list(keys), value)
    else:
        q = F.percentile_approx(value, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
        out = rows.groupBy(*keys).agg(F.count(value).alias("n"), q.alias("q"), F.min(value).alias("lo"), F.max(value).alias("hi")).where("n > 0")
    whole = lambda c: F.bround(c, 0).cast("int")
    return out.select(*keys, "n", *[whole(F.col("q")[k]).alias(f"p{x}") for k, x in enumerate((25, 50, 75))], F.round("lo", 0).cast("int").alias("min_wage"), F.round("hi", 0).cast("int").alias("max_wage"))


def outcome_counts() -> list[Column]:
    return [F.count_if(F.col("case_status") == v).alias(k) for k, v in OUTCOMES.items()]


def employer_outcomes(f: DataFrame) -> DataFrame:
    out = f.where("canonical_employer_id IS NOT NULL").groupBy("canonical_employer_id").agg(F.count("*").alias("filings"), *outcome_counts())
    return out.select("*", *[per_100(F.col(k), F.col("filings")).alias(f"{k}_pct") for k in OUTCOMES])


def state_share_by_year(f: DataFrame, k: int = 6) -> DataFrame:
    top = top_n(count_by(f.where(valid_state(F.col("worksite_state"))), "worksite_state"), "filings", k, "worksite_state")
    return count_by(or_other(f, "worksite_state", top, "Other", "state"), "filing_year", "state")


def soc_share_by_year(f: DataFrame, k: int = 10) -> DataFrame:
    rows = f.where("soc_code IS NOT NULL")
    top = top_n(count_by(rows, "soc_code"), "filings", k, "soc_code")
    return share_of(count_by(or_other(rows, "soc_code", top, "(other)", "code"), "filing_year", "code"), ["filing_year"], "filings", "pct")


def state_concentration(f: DataFrame, n: int = 15) -> DataFrame:
    rows = f.where(valid_state(F.col("worksite_state")) & F.col("canonical_employer_id").isNotNull())
    share = share_of(count_by(rows, "worksite_state", "canonical_employer_id"), ["worksite_state"], "filings", "pct")
    return top_n_per_group(share, ["worksite_state"], "filings", n, "canonical_employer_id", rank="rank")


def employer_growth(f: DataFrame, k: int = 300) -> DataFrame:
    rows = f.where("canonical_employer_id IS NOT NULL")
    top = top_n(count_by(rows, "canonical_employer_id"), "filings", k, "canonical_employer_id").select("canonical_employer_id")
    return rows.join(F.broadcast(top), "canonical_employer_id", "left_semi").groupBy("canonical_employer_id", "filing_year").agg(F.count("*").alias("filings"), *outcome_counts())


def wage_premium(w: DataFrame) -> DataFrame:
    """Quartiles of the offered by the prevailing wage, and how many are near 1."""
    pair = F.transform(F.array(F.struct("wage", "pw")), lambda x: F.when(in_gate(x["wage"]) & (x["pw"] > 0), x["wage"] / x["pw"]))[0]
    rows = w.where("soc_code IS NOT NULL").select("soc_code", pair.alias("ratio"))
    near = rows.groupBy("soc_code", "ratio").agg(F.count("ratio").alias("_c")).where("_c > 0")
    near = near.groupBy("soc_code").agg(F.sum(F.when(F.col("ratio").between(0.98, 1.02), F.col("_c")).otherwise(0)).alias("near_floor"))
    out = quantiles(rows, ["soc_code"], "ratio").join(near, "soc_code")
    return out.select("soc_code", "n", *[F.round(F.col("q")[k], 3).alias(f"ratio_p{x}") for k, x in enumerate((25, 50, 75))], "near_floor")


def overview_kpis(f: DataFrame, entities: DataFrame) -> DataFrame:
    one = f.agg(
        F.count("*").alias("filings"), F.min("filing_year").alias("first_year"), F.max("filing_year").alias("last_year"),
        F.count_distinct("soc_code").alias("codes"), F.count_distinct("worksite_state").alias("states"),
        F.count_if(F.col("soc_code").isNotNull()).alias("classified"), F.count_if(F.col("canonical_employer_id").isNull()).alias("orphans"),
    )
    return one.withColumn("years", F.col("last_year") - F.col("first_year") + 1).join(entities.agg(F.count("*").alias("entities")))


def pair_consensus(df: DataFrame, keys: list[str], value: str, label: str, min_hits: int = 5, min_agreement: float = 0.8, distinct_col: str | None = None, min_distinct: int = 1) -> DataFrame:
    """Values that a key has with hits and agreement of at least so much; the label is the most frequent, of equals the least."""
    many = F.count_distinct(distinct_col) if distinct_col else F.lit(1)
    # The label's mode over pre-counted labels: two partial aggregates, no list of labels.
    pairs = df.groupBy(*keys, value).agg(F.count("*").alias("hits"), many.cast("long").alias("distinct_n"))
    labels = top_n_per_group(df.groupBy(*keys, value, label).agg(F.count("*").alias("_n")), [*keys, value], "_n", 1, label).drop("_n")
    total = F.sum("hits").over(Window.partitionBy(*keys))
    out = pairs.withColumn("agreement", F.col("hits") / total).where((F.col("hits") >= min_hits) & (F.col("agreement") >= min_agreement) & (F.col("distinct_n") >= min_distinct))
    return out.join(labels, [*keys, value])


def site_yearly(f: DataFrame) -> DataFrame:
    w = wage_stats(waged(f), "filing_year").select("filing_year", F.col("p50").alias("median_wage"))
    dims = f.groupBy("filing_year").agg(F.count_distinct("canonical_employer_id").alias("employers"), F.count_distinct("soc_code").alias("codes"))
    return count_by(f, "filing_year").join(w, "filing_year", "left").join(dims, "filing_year", "left")


def site_kpis(f: DataFrame) -> DataFrame:
    """One row: filings, the latest year, and the rounded mean of the yearly median wages."""
    y = site_yearly(f)
    return y.agg(F.sum("filings").alias("filings"), F.max("filing_year").alias("last_year"), F.round(F.avg("median_wage"), 0).cast("long").alias("mean_median_wage"))


def confidence_distribution(f: DataFrame) -> DataFrame:
    return count_by(f.where("soc_source = 'stage2'"), bucketize(F.col("soc_confidence")).alias("bucket"))


def sector_summary(f: DataFrame) -> DataFrame:
    rows = f.withColumn("sector", naics2(F.col("naics_code"))).where("sector IS NOT NULL")
    return rows.groupBy("sector").agg(F.count("*").alias("filings"), F.count_distinct("canonical_employer_id").alias("employers"))
