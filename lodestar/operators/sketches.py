"""Mergeable sketches: stored per key and year, merged for any years and any coarser key without reading the filings again.

Wage percentiles come from KLL sketches, whose rank error shrinks about with 1 / k (under 0.6 % at k = 1000, with 99 % confidence);
numbers of employers and codes from HyperLogLog sketches of 2^lg_k registers (a standard error of 1.6 % at lg_k = 12). Both are exact
for few values. Where exact results are needed, the rollups of rollups.py count the values themselves.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.functions.scalar import in_gate


def yearly_sketches(w: DataFrame, *keys: str, k: int = 1000, lg_k: int = 12) -> DataFrame:
    """keys, filing_year, filings, and sketches: wages (inside the gate), employers and codes. w: filings with wage."""
    wage = F.transform(F.array("wage"), lambda a: F.when(in_gate(a), a))[0]
    rows = w.select(*keys, "filing_year", wage.alias("_wage"), "canonical_employer_id", F.col("soc_code").alias("_code"))
    return rows.groupBy(*keys, "filing_year").agg(
        F.count("*").alias("filings"), F.kll_sketch_agg_double("_wage", F.lit(k)).alias("wages"),
        F.hll_sketch_agg("canonical_employer_id", F.lit(lg_k)).alias("employers"), F.hll_sketch_agg("_code", F.lit(lg_k)).alias("codes"),
    )


def merged(sketches: DataFrame, *keys: str, years: tuple[int, int] | None = None) -> DataFrame:
    """The sketches of coarser keys, of all years or of those from the first to the second."""
    rows = sketches if years is None else sketches.where(F.col("filing_year").between(*years))
    return rows.groupBy(*keys).agg(F.sum("filings").alias("filings"), F.kll_merge_agg_double("wages").alias("wages"), F.hll_union_agg("employers").alias("employers"), F.hll_union_agg("codes").alias("codes"))


def estimates(rows: DataFrame, *keys: str, ps: tuple[float, ...] = (0.25, 0.5, 0.75)) -> DataFrame:
    """keys, filings, n (wages inside the gate), their percentiles (null without any), and the numbers of employers and codes."""
    n = F.coalesce(F.kll_sketch_get_n_double("wages"), F.lit(0)).cast("long")
    at = lambda p: F.when(n > 0, F.kll_sketch_get_quantile_double("wages", F.lit(p)))
    return rows.select(*keys, "filings", n.alias("n"), *[at(p).alias(f"p{round(100 * p)}") for p in ps], F.hll_sketch_estimate("employers").alias("employers"), F.hll_sketch_estimate("codes").alias("codes"))


def within(w: DataFrame, estimated: DataFrame, *keys: str, rank: float = 0.02, share: float = 0.08, ps: tuple[float, ...] = (0.25, 0.5, 0.75)) -> DataFrame:
    """keys, filings, n, and whether each estimate is in its bound: percentiles by their rank among all wages, numbers by their ratio."""
    wage = F.transform(F.array("wage"), lambda a: F.when(in_gate(a), a))[0]
    rows = w.select(*keys, wage.alias("_wage"), "canonical_employer_id", F.col("soc_code").alias("_code")).join(F.broadcast(estimated), list(keys))
    below: list[Column] = []
    for p in ps:
        e = F.col(f"p{round(100 * p)}")
        low, high = F.count_if(F.col("_wage") < e) / F.count("_wage"), F.count_if(F.col("_wage") <= e) / F.count("_wage")
        below.append((F.coalesce(low <= p + rank, F.lit(True)) & F.coalesce(high >= p - rank, F.lit(True))).alias(f"p{round(100 * p)}_ok"))
    near = lambda c, exact: (F.abs(F.max(c) - F.count_distinct(exact)) <= 1 + share * F.count_distinct(exact)).alias(f"{c}_ok")
    return rows.groupBy(*keys).agg(F.max("filings").alias("filings"), F.max("n").alias("n"), *below, near("employers", "canonical_employer_id"), near("codes", "_code"))
