"""Sketches per year, merged over years and keys, against the exact rollups."""

import pytest
from pyspark.sql import functions as F

from lodestar.fixtures import filings
from lodestar.operators import rollups as R
from lodestar.operators import serving as V
from lodestar.operators import sketches as K


@pytest.fixture(scope="module")
def waged(spark, sf):
    return R.waged(filings(spark, sf))


def test_merged_sketches_are_in_their_bounds(spark, waged, tmp_path):
    K.yearly_sketches(waged, "soc_code", "worksite_state").write.parquet(str(tmp_path / "s"))
    stored = spark.read.parquet(str(tmp_path / "s"))
    for keys, years in ((("soc_code",), None), (("worksite_state",), None), (("soc_code",), (1996, 1998))):
        part = waged if years is None else waged.where(F.col("filing_year").between(*years))
        got = K.within(part, K.estimates(K.merged(stored, *keys, years=years), *keys), *keys).collect()
        exact = {r[0]: r.n for r in R.wage_stats(part, *keys).collect()}
        assert len(got) > 5 and {r[0]: r.n for r in got if r.n} == {k: n for k, n in exact.items() if k is not None}
        assert all(r[c] for r in got for c in r.asDict() if c.endswith("_ok"))


def test_groups_without_wages(spark):
    rows = spark.createDataFrame([("a", 2000, None, "e", "c"), ("a", 2001, 5.0, None, None), ("b", 2000, 30000.0, "e", "c")], "soc_code string, filing_year int, wage double, canonical_employer_id string, x string")
    got = {r.soc_code: r for r in K.estimates(K.merged(K.yearly_sketches(rows, "soc_code"), "soc_code"), "soc_code").collect()}
    assert (got["a"].n, got["a"].p50, got["a"].employers, got["a"].filings) == (0, None, 1, 2)
    assert (got["b"].n, got["b"].p50) == (1, 30000.0)


def test_unfiltered_lookup_reads_the_rollup(spark, waged):
    rollup = R.wage_stats(waged.where("soc_code IS NOT NULL"), "soc_code")
    code = rollup.orderBy(F.desc("n")).first().soc_code
    want = V.wage_lookup(waged, code).collect()
    assert V.wage_lookup(None, code, rollup=rollup).collect() == want
    assert V.wage_lookup(waged, code, "TX", rollup=rollup).collect() == V.wage_lookup(waged, code, "TX").collect()
