"""Quantiles by two levels of prefix sums against sorted lists, and what their plans read and order."""

import math
import random

import pytest
from pyspark.sql import functions as F

from lodestar.operators import rollups as R


def brute(values, p):
    v = sorted(values)
    w = (len(v) - 1) * p
    lo, hi = v[math.floor(w)], v[math.ceil(w)]
    return lo if lo == hi else (1 - (w - math.floor(w))) * lo + (w - math.floor(w)) * hi


@pytest.mark.parametrize("fine", [1, 256])
def test_quantiles_equal_sorted_lists(spark, fine):
    rng, rows = random.Random(1), []
    for key in ("a", "b", None):
        rows += [(key, rng.choice([rng.uniform(-5, 5), rng.lognormvariate(10, 2), -rng.lognormvariate(3, 1), 0.0, 7.5])) for _ in range(rng.randint(150, 300))]
    rows += [("one", 3.0), ("two", 1.0), ("two", 2.0), ("equal", 4.0), ("equal", 4.0), ("null", None), ("some", None), ("some", 5.0), (None, None)]
    ps = (0.0, 0.1, 0.25, 0.5, 0.75, 0.999, 1.0)
    got = {r.k: r for r in R.quantiles(spark.createDataFrame(rows, "k string, v double"), ["k"], "v", ps, fine).collect()}
    want = {}
    for k, v in rows:
        if v is not None:
            want.setdefault(k, []).append(v)
    assert set(got) == set(want)
    for k, v in want.items():
        assert got[k].n == len(v) and (got[k].lo, got[k].hi) == (min(v), max(v))
        assert got[k].q == pytest.approx([brute(v, p) for p in ps], rel=1e-12, abs=1e-12)


def test_values_are_counted_once_and_few_are_ordered(spark):
    rows = spark.range(200_000).select((F.col("id") % 3).alias("k"), (F.col("id") * 7919 % 200_003 + 1).cast("double").alias("v"))
    out = R.quantiles(rows, ["k"], "v")
    assert len(out.collect()) == 3
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "ReusedExchange" in plan
    row = R.quantiles(rows, ["k"], "v", (0.5,)).where("k = 1").first()
    assert row.q == pytest.approx([brute([i * 7919 % 200_003 + 1.0 for i in range(1, 200_000, 3)], 0.5)])
