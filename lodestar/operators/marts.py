"""The serving mart: tables of employers, occupations, states and sectors with their top lists and yearly rows.

The leading entities of each kind get a page; employers that only a top list of another kind names get one as well, without a
rank, so that every link ends at a row. A link carries the slug of the employer's row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.functions.scalar import code_slug, disambiguate, naics2, sector_slug, slugify, state_slug, valid_state

from lodestar.sources.scratch import stored

from .rollups import OUTCOMES, count_by, employer_outcomes, global_rank, outcome_counts, sector_summary, state_concentration, top_n_per_group, wage_stats, waged

#: Sizes of the mart: pages of each kind, rows of a top list, and the filings that a year's wages of an occupation need.
SIZES = {"employers": 2000, "occupations": 300, "states": 60, "sectors": 30, "list": 10, "state_list": 15, "paying": 8, "paying_least": 50, "state_wages_least": 25}


def _ranked(df: DataFrame, key: str, n: int) -> DataFrame:
    return global_rank(df, key, "filings", n, key).where("rank IS NOT NULL")


def _lists(counts: DataFrame, key: str, of: DataFrame, item: str, n: int) -> DataFrame:
    """The n leading items of each key that has a page."""
    return top_n_per_group(counts.join(F.broadcast(of.select(key)), key, "left_semi"), [key], "filings", n, item, rank="rank")


def build(f: DataFrame, entities: DataFrame, titles: DataFrame, state_names: DataFrame, sector_names: DataFrame, sizes: dict[str, int] | None = None) -> dict[str, DataFrame]:
    """name -> table. titles: (soc_code, title), state_names and sector_names: (code, label); a sector without a label is named by
    its code. The top lists of employers count all their filings. Pages of a kind are bounded by sizes, so they are broadcast."""
    s = SIZES | (sizes or {})
    # Filings may be a join of large tables and wages are parsed from text, and nearly every table needs them several times.
    w = stored(waged(f).select("soc_code", "canonical_employer_id", "worksite_state", "naics_code", "filing_year", "case_status", "pw_wage_level", "wage"))
    f = w.drop("wage")
    named = entities.select(F.col("id").alias("canonical_employer_id"), F.col("canonical_name").alias("name"), "employer_state", "fein")
    title = titles.groupBy("soc_code").agg(F.min("title").alias("soc_title"))
    with_title = lambda df: df.join(title, "soc_code", "left")
    sector = naics2(F.col("naics_code")).alias("sector")
    coded, known = f.where("soc_code IS NOT NULL"), f.where("canonical_employer_id IS NOT NULL")

    occupations = _ranked(count_by(coded, "soc_code"), "soc_code", s["occupations"])
    states = _ranked(count_by(f.where(valid_state(F.col("worksite_state"))), "worksite_state"), "worksite_state", s["states"])
    sectors = _ranked(sector_summary(f), "sector", s["sectors"])
    by_soc_employer = count_by(coded.where("canonical_employer_id IS NOT NULL"), "soc_code", "canonical_employer_id")
    occupation_employers = _lists(by_soc_employer, "soc_code", occupations, "canonical_employer_id", s["list"])
    state_employers = state_concentration(f, s["state_list"]).join(F.broadcast(states.select("worksite_state")), "worksite_state", "left_semi")
    sector_employers = _lists(count_by(known, sector, "canonical_employer_id").where("sector IS NOT NULL"), "sector", sectors, "canonical_employer_id", s["list"])

    outcomes = employer_outcomes(f).join(named, "canonical_employer_id")
    top = disambiguate(_ranked(outcomes, "canonical_employer_id", s["employers"]), "name", "employer_state", "fein", "canonical_employer_id")
    linked = occupation_employers.select("canonical_employer_id").union(state_employers.select("canonical_employer_id")).union(sector_employers.select("canonical_employer_id")).distinct()
    tail = outcomes.join(linked.join(top, "canonical_employer_id", "left_anti"), "canonical_employer_id", "left_semi").withColumns({"rank": F.lit(None).cast("int"), "display": F.col("name")})
    every = top.unionByName(tail)
    every = every.withColumn("slug", F.coalesce(F.nullif(slugify(F.col("name")), F.lit("")), F.concat(F.lit("employer-"), "canonical_employer_id")))
    every = _slugs(every, F.coalesce("rank", F.lit(2**31 - 1)), F.col("canonical_employer_id"))
    yearly = known.groupBy("canonical_employer_id", "filing_year").agg(F.count("*").alias("filings"), *outcome_counts())
    pages = every.select("canonical_employer_id", "slug", "display")
    years = yearly.groupBy("canonical_employer_id").agg(F.min("filing_year").alias("first_year"), F.max("filing_year").alias("last_year"))
    link = lambda df, *cols: df.join(pages, "canonical_employer_id").select(*cols, F.col("slug").alias("employer_slug"), F.col("display").alias("canonical_name"), "filings", "rank")
    own = lambda df: df.join(pages.select("canonical_employer_id", F.col("slug").alias("employer_slug")), "canonical_employer_id").drop("canonical_employer_id")

    stats = lambda *keys: wage_stats(w.where("soc_code IS NOT NULL"), *keys).withColumnRenamed("n", "n_wages")
    on_pages = lambda df: df.join(F.broadcast(occupations.select("soc_code")), "soc_code", "left_semi")
    wages = ["n_wages", F.col("p25").alias("p25_wage"), F.col("p50").alias("p50_wage"), F.col("p75").alias("p75_wage")]
    page = with_title(occupations).withColumn("slug", code_slug(F.col("soc_title"), F.col("soc_code")))
    occupation = page.join(stats("soc_code"), "soc_code", "left")
    by_state = stats("soc_code", "worksite_state").where(F.col("n_wages") >= s["state_wages_least"])
    paying = stats("soc_code", "filing_year").where(F.col("n_wages") >= s["paying_least"])
    paying = with_title(top_n_per_group(paying, ["filing_year"], "p50", s["paying"], "soc_code", rank="rank")).join(page.select("soc_code", "slug"), "soc_code", "left")
    label = lambda df, key, names: df.join(names.select(F.col("code").alias(key), F.col("label")), key, "left")
    state = label(states, "worksite_state", state_names)
    sector_pages = label(sectors, "sector", sector_names).withColumn("label", F.coalesce("label", F.concat(F.lit("Sector "), "sector")))
    sector_counts = lambda key: _lists(count_by(f.where(F.col(key).isNotNull()), sector, key).where("sector IS NOT NULL"), "sector", sectors, key, s["list"])

    return {
        "employer": every.drop("slug_unique", "name").withColumnRenamed("display", "canonical_name").join(years, "canonical_employer_id", "left"),
        "employer_top_soc": with_title(own(top_n_per_group(by_soc_employer.join(pages.select("canonical_employer_id"), "canonical_employer_id", "left_semi"), ["canonical_employer_id"], "filings", s["list"], "soc_code", rank="rank"))),
        "employer_yearly": own(yearly),
        "occupation": occupation.select("soc_code", "slug", "soc_title", "filings", *wages, "rank"),
        "occupation_level": on_pages(stats("soc_code", "pw_wage_level").where(F.col("pw_wage_level").isin("I", "II", "III", "IV"))).select("soc_code", "pw_wage_level", *wages),
        "occupation_top_state": on_pages(top_n_per_group(by_state, ["soc_code"], "n_wages", s["list"], "worksite_state", rank="rank")).select("soc_code", "worksite_state", "n_wages", F.col("p50").alias("p50_wage"), "rank"),
        "occupation_top_employer": link(occupation_employers, "soc_code"),
        "occupation_yearly": on_pages(stats("soc_code", "filing_year")).select("soc_code", "filing_year", *wages),
        "site_top_paying_occ_yearly": paying.select("filing_year", "soc_code", "soc_title", "slug", F.col("p50").alias("p50_wage"), "n_wages", "rank"),
        "state": state.select("worksite_state", state_slug(F.coalesce("label", "worksite_state"), F.col("worksite_state")).alias("slug"), F.coalesce("label", "worksite_state").alias("name"), "filings", "rank"),
        "state_top_employer": link(state_employers, "worksite_state", "pct"),
        "state_top_occupation": with_title(_lists(count_by(coded, "worksite_state", "soc_code"), "worksite_state", states, "soc_code", s["list"])),
        "state_yearly": count_by(f, "worksite_state", "filing_year").join(F.broadcast(states.select("worksite_state")), "worksite_state", "left_semi"),
        "sector": sector_pages.select("sector", sector_slug(F.col("label"), F.col("sector")).alias("slug"), "label", "filings", "employers", "rank"),
        "sector_yearly": count_by(f, sector, "filing_year").join(F.broadcast(sectors.select("sector")), "sector", "left_semi"),
        "sector_top_employer": link(sector_employers, "sector"),
        "sector_top_occupation": with_title(sector_counts("soc_code")),
        "sector_top_state": sector_counts("worksite_state"),
    }


def _slugs(df: DataFrame, *order: Column) -> DataFrame:
    """slug with -2, -3 … for all but the first of equal ones."""
    from pyspark.sql import Window

    k = F.row_number().over(Window.partitionBy("slug").orderBy(*order))
    return df.withColumn("slug", F.when(k > 1, F.concat_ws("-", "slug", k.cast("string"))).otherwise(F.col("slug")))


def documents(page: DataFrame, key: str, lists: dict[str, tuple[DataFrame, list[str]]], kind: str) -> DataFrame:
    """A nested JSON document per page: its columns, its URL, and each list (frame keyed by key, columns to order by) as an array."""
    out = page.withColumn("url", F.concat(F.lit(f"/{kind}/"), "slug"))
    for name, (rows, order) in lists.items():
        items = F.struct(*order, *[c for c in rows.columns if c not in {key, *order}])
        out = out.join(rows.groupBy(key).agg(F.array_sort(F.collect_list(items)).alias(name)), key, "left")
    return out.select(key, F.to_json(F.struct(*[c for c in out.columns if c != key])).alias("doc"))
