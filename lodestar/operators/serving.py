"""Queries over rollups: leaderboards, movers, comparison, search, entity documents, projections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestar.functions.scalar import per_100, slugify

from .rollups import count_by, top_n, top_n_per_group


def growth(yearly: DataFrame, key: str, metric: str, floor_first: int, floor_total: int) -> DataFrame:
    """First against last year per key, in percent to one digit."""
    g = yearly.groupBy(key).agg(F.min_by(metric, "filing_year").alias("first_n"), F.max_by(metric, "filing_year").alias("last_n"), F.sum(metric).alias("total"), F.count("*").alias("years"))
    g = g.where((F.col("first_n") >= floor_first) & (F.col("total") >= floor_total) & (F.col("years") > 1))
    return g.withColumn("growth_pct", F.floor((2000 * (F.col("last_n") - F.col("first_n")) + F.col("first_n")) / (2 * F.col("first_n"))) / 10.0)


def share_movers(yearly: DataFrame, key: str, metric: str = "filings", min_volume: int = 0, k: int = 12) -> DataFrame:
    """Change of each key's share of a year's total between the last two years, in hundredths of a percentage point; the k largest."""
    years = yearly.agg(F.max("filing_year").alias("y"))
    two = yearly.join(F.broadcast(years), yearly.filing_year >= F.col("y") - 1)
    sums = two.groupBy(key).agg(*[F.coalesce(F.sum(F.when(F.col("filing_year") == F.col("y") - d, F.col(metric))), F.lit(0)).alias(n) for n, d in (("now_n", 0), ("prev_n", 1))])
    totals = F.broadcast(sums.agg(F.sum("now_n").alias("now_t"), F.sum("prev_n").alias("prev_t")))
    moved = sums.where(F.col("now_n") + F.col("prev_n") >= min_volume).join(totals)
    bp = lambda a, t: F.floor(F.col(a) * 10000 / F.nullif(F.col(t), F.lit(0)))
    moved = moved.withColumn("delta_bp", F.coalesce(bp("now_n", "now_t"), F.lit(0)) - F.coalesce(bp("prev_n", "prev_t"), F.lit(0)))
    return moved.orderBy(F.desc(F.abs("delta_bp")), key).limit(k).select(key, "now_n", "prev_n", "delta_bp")


def entity_kpis(yearly: DataFrame, key: str, metric: str = "filings", min_volume: int = 0, k: int = 5) -> DataFrame:
    """One row: the total, the number of keys, the share of the k largest, and the key whose share moved most in the last two years."""
    sums = yearly.groupBy(key).agg(F.sum(metric).alias("n"))
    leaders = top_n(sums, "n", k, key).agg(F.sum("n").alias("top_n"))
    totals = sums.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"), F.count("*").alias("entities"))
    mover = share_movers(yearly, key, metric, min_volume, 1).agg(F.first(key).alias("mover"), F.first("delta_bp").alias("mover_bp"))
    return totals.join(leaders).join(mover).select("total", "entities", per_100(F.col("top_n"), F.col("total")).alias("top_share_pct"), "mover", "mover_bp")


def in_region(rows: DataFrame, key: str, states: DataFrame, region: str | None = None) -> DataFrame:
    """Rows whose state lies in a region, all rows without one. states: code, region; a few rows by construction."""
    if region is None:
        return rows
    codes = F.broadcast(states.where(F.col("region") == region).select(F.col("code").alias(key)))
    return rows.join(codes, key, "left_semi")


def donut(rows: DataFrame, key: str, metric: str, k: int = 8, other: str = "Other sectors") -> DataFrame:
    top = F.broadcast(top_n(rows, metric, k, key).select(F.col(key).alias("_k")))
    return rows.join(top, F.col(key) == F.col("_k"), "left").groupBy(F.coalesce("_k", F.lit(other)).alias("slice")).agg(F.sum(metric).alias(metric))


def compare(df: DataFrame, key: str, a: str, b: str, metrics: dict[str, str]) -> DataFrame:
    """One row per metric of two entities: values and the winner by high, low or none."""
    long = df.where(F.col(key).isin(a, b)).select(key, F.explode(F.create_map(*[x for m in metrics for x in (F.lit(m), F.col(m).cast("double"))])).alias("metric", "value"))
    two = long.groupBy("metric").agg(*[F.max(F.when(F.col(key) == v, F.col("value"))).alias(n) for n, v in (("a_value", a), ("b_value", b))])
    rule = F.create_map(*[F.lit(x) for kv in metrics.items() for x in kv])[F.col("metric")]
    lead = F.when(F.col("a_value") == F.col("b_value"), "tie").when((F.col("a_value") > F.col("b_value")) == (rule == "high"), "a").otherwise("b")
    return two.withColumn("winner", F.when(rule == "none", F.lit(None).cast("string")).when(F.col("a_value").isNotNull() & F.col("b_value").isNotNull(), lead))


def compare_metrics(f: DataFrame, wages: DataFrame, key: str) -> DataFrame:
    """Per key: filings, filings per employer, share of all filings, and the middle half's spread of wages."""
    counts = f.groupBy(key).agg(F.count("*").alias("filings"), F.count_distinct("canonical_employer_id").alias("employers"))
    counts = counts.withColumn("share_pct", per_100(F.col("filings"), F.sum("filings").over(Window.partitionBy()))).where(F.col(key).isNotNull())
    per = F.floor((2 * F.col("filings") + F.col("employers")) / F.nullif(2 * F.col("employers"), F.lit(0))).alias("per_employer")
    return counts.join(wages.select(key, "p50", (F.col("p75") - F.col("p25")).alias("spread")), key, "left").select(key, "filings", per, "share_pct", "p50", "spread")


def yearly_overlay(yearly: DataFrame, key: str, a: str, b: str) -> DataFrame:
    one = lambda v, n: yearly.where(F.col(key) == v).select("filing_year", F.col("filings").alias(n))
    both = one(a, "a").join(one(b, "b"), "filing_year", "full_outer")
    return both.select("filing_year", F.coalesce("a", F.lit(0)).alias("a"), F.coalesce("b", F.lit(0)).alias("b"))


def search(kinds: dict[str, tuple[DataFrame, str] | tuple[DataFrame, str, Column]], q: str, k: int = 10) -> DataFrame:
    """The k largest names per kind that contain q, or for which the kind's own condition holds; nothing for fewer than two characters."""
    hits = None
    for kind, (df, name, *also) in kinds.items():
        found = F.lower(name).contains(F.lit(q.lower()))
        for condition in also:
            found = F.coalesce(found, F.lit(False)) | condition
        one = df.where(found).select(F.lit(kind).alias("kind"), F.col(name).alias("name"), "filings")
        hits = one if hits is None else hits.unionByName(one)
    hits = hits.where(F.lit(len(q.strip()) >= 2))
    return top_n_per_group(hits, ["kind"], "filings", k, "name", rank="rank")


def pivot_yearly(yearly: DataFrame, key: str, metric: str, first: int, last: int) -> DataFrame:
    """One array per key over all years, null where a year is missing."""
    at = F.map_from_entries(F.collect_list(F.struct("filing_year", metric)))
    years = F.sequence(F.lit(first), F.lit(last))
    return yearly.groupBy(key).agg(at.alias("_m")).select(key, F.transform(years, lambda y: F.try_element_at("_m", y)).alias("series"))


def entity_documents(yearly: DataFrame, key: str, name: str) -> DataFrame:
    """A nested JSON document per entity: slug, total and its years in order."""
    years = F.array_sort(F.collect_list(F.struct("filing_year", "filings")))
    d = yearly.groupBy(key, name).agg(F.sum("filings").alias("total"), years.alias("yearly"))
    return d.select(key, F.to_json(F.struct(slugify(F.col(name)).alias("slug"), "total", "yearly")).alias("doc"))


def changed_entities(docs: DataFrame, previous: DataFrame, key: str, version: str) -> DataFrame:
    """Entities whose content hash the previous run doesn't have."""
    hashed = docs.withColumn("hash", F.sha2(F.concat(F.col("doc"), F.lit(version)), 256))
    return hashed.join(previous.select(key, "hash"), [key, "hash"], "left_anti")


def redirects(past: DataFrame, current: DataFrame, archives: DataFrame, previous: DataFrame) -> DataFrame:
    """Targets of slugs that are gone: the newest archive that has one, else the previous target, else the list page."""
    gone = past.select("slug").union(previous.select("slug")).distinct().join(current.select("slug"), "slug", "left_anti")
    newest = archives.groupBy("slug").agg(F.max("label").alias("label"))
    target = F.coalesce(F.concat(F.lit("/archive/"), "label", F.lit("/"), "slug"), F.col("target"), F.lit("/list"))
    return gone.join(newest, "slug", "left").join(previous.select("slug", "target"), "slug", "left").select("slug", target.alias("target"))


def linear_projection(series: DataFrame, key: str, year: str, value: str, window: int = 8) -> DataFrame:
    """Least squares on the last years of every series: next year's value, never under 0, with a band of 1.5 residual errors."""
    w = Window.partitionBy(key).orderBy(F.desc(year))
    rows = series.where(F.col(value).isNotNull()).withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= window)
    y, x = F.col(value).cast("double"), F.col(year).cast("double")
    fit = rows.groupBy(key).agg(F.count("*").alias("n"), F.max(year).alias("last_year"), F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.regr_syy(y, x).alias("syy"), F.regr_sxy(y, x).alias("sxy"))
    fit = fit.where("n >= 3")
    nxt = F.col("last_year") + 1
    mid = F.col("intercept") + F.col("slope") * nxt
    band = 1.5 * F.sqrt(F.greatest(F.col("syy") - F.col("slope") * F.col("sxy"), F.lit(0.0)) / (F.col("n") - 2))
    clip = lambda c: F.round(F.greatest(c, F.lit(0.0)), 1)
    return fit.select(key, "n", nxt.cast("int").alias("next_year"), clip(mid).alias("projected"), clip(mid - band).alias("low"), clip(mid + band).alias("high"))


def cagr(yearly: DataFrame, key: str, metric: str) -> DataFrame:
    g = yearly.groupBy(key).agg(F.min_by(metric, "filing_year").alias("a"), F.max_by(metric, "filing_year").alias("b"), (F.max("filing_year") - F.min("filing_year")).alias("years"))
    rate = F.when((F.col("a") > 0) & (F.col("b") > 0) & (F.col("years") > 0), F.round((F.pow(F.col("b") / F.col("a"), 1 / F.col("years")) - 1) * 100, 1)).otherwise(0.0)
    return g.select(key, "years", rate.alias("cagr_pct"))


def sponsor_risk(outcomes: DataFrame, min_filings: int, sort: str, k: int) -> DataFrame:
    return top_n(outcomes.where(F.col("filings") >= min_filings), sort, k, "canonical_employer_id")


def first_last_year(f: DataFrame, key: str) -> DataFrame:
    return f.groupBy(key).agg(F.min("filing_year").alias("first_year"), F.max("filing_year").alias("last_year"))


def wage_lookup(waged: DataFrame | None, code: str, state: str | None = None, city: str | None = None, rollup: DataFrame | None = None) -> DataFrame:
    """Wage percentiles of a code; without state and city from the rollup by code, if there is one, else from the filings."""
    from .rollups import wage_stats

    if rollup is not None and not state and not city:
        return rollup.where(F.col("soc_code") == code)
    rows = waged.where(F.col("soc_code") == code)
    rows = rows.where(F.col("worksite_state") == state) if state else rows
    return wage_stats(rows.where(F.lower("worksite_city") == city.lower()) if city else rows, "soc_code")


def region_counts(f: DataFrame, regions: dict[str, str]) -> DataFrame:
    region = F.create_map(*[F.lit(x) for kv in regions.items() for x in kv])
    return count_by(f, F.coalesce(F.try_element_at(region, F.col("worksite_state")), F.lit("Other")).alias("region")).withColumn("pct", per_100(F.col("filings"), F.sum("filings").over(Window.partitionBy())))


def re_rank(rows: DataFrame, metric: str, *ties: str) -> DataFrame:
    """Rows of a small dimension with rank by metric, nulls last, and the share of the metric's total."""
    w = Window.orderBy(F.desc_nulls_last(metric), *ties)
    return rows.withColumn("rank", F.row_number().over(w)).withColumn("share", F.round(F.col(metric) / F.sum(metric).over(Window.partitionBy()), 6))


def scoped_kpis(f: DataFrame, key: str, year: int, outcomes: dict[str, str]) -> DataFrame:
    """Per key the number of filings and outcomes in one year; those of all years where the key has none in it."""
    here = F.col("filing_year") == year
    counted = lambda c: F.when(F.count_if(here) > 0, F.count_if(here & c)).otherwise(F.count_if(c))
    scope = F.when(F.count_if(here) > 0, "year").otherwise("all")
    return f.groupBy(key).agg(scope.alias("scope"), counted(F.lit(True)).alias("filings"), *[counted(F.col("case_status") == v).alias(k) for k, v in outcomes.items()])


def scoped_wages(w: DataFrame, key: str, year: int) -> DataFrame:
    """Per key the wage percentiles and the share of all filings in one year; those of all years where the key has no filing in it."""
    from .rollups import wage_stats

    rows = w.where(F.col(key).isNotNull())
    here = rows.where(F.col("filing_year") == year)

    def one(scoped: DataFrame, everything: DataFrame, tag: str) -> DataFrame:
        total = F.broadcast(everything.agg(F.count("*").alias("n_all")))
        counts = count_by(scoped, key, out="n_filings").join(total).select(key, per_100(F.col("n_filings"), F.col("n_all")).alias("share_pct"))
        stats = wage_stats(scoped, key).select(key, "p25", "p50", "p75")
        return counts.join(stats, key, "left").select(F.col(key), *[F.col(c).alias(f"{c}_{tag}") for c in ("share_pct", "p25", "p50", "p75")])

    both = one(rows, w, "all").join(one(here, w.where(F.col("filing_year") == year), "year"), key, "left")
    there = F.col("share_pct_year").isNotNull()
    return both.select(key, F.when(there, "year").otherwise("all").alias("scope"), *[F.when(there, F.col(f"{c}_year")).otherwise(F.col(f"{c}_all")).alias(c) for c in ("share_pct", "p25", "p50", "p75")])


def queue_counts(records: DataFrame, threshold: float = 0.7) -> DataFrame:
    """One row: rows to review, rows without a code, rows without an entity."""
    return records.agg(F.count_if(F.col("soc_confidence") < threshold).alias("review"), F.count_if(F.col("soc_code").isNull()).alias("quarantined"), F.count_if(F.col("canonical_employer_id").isNull()).alias("unresolved"))
