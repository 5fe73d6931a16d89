"""Limits of the backfill and of embedding, and the guard of the refresh."""

import pytest

from lodestar.operators import linkage as K
from lodestar.plans.refresh import rollup_refresh, unrefreshed


def test_a_limited_backfill_takes_the_first_rows(spark):
    queue = spark.createDataFrame([("Zeta", "TX", None), ("Alpha", None, None), ("Beta", "CA", None)], "name string, state string, fein string")
    entities = spark.createDataFrame([("e1", "Gamma", "TX", None)], "id string, canonical_name string, employer_state string, fein string")
    records = spark.createDataFrame([("r1", "Zeta", "TX", None)], "record_id string, employer_name string, employer_state string, canonical_employer_id string")
    taken = lambda n: sorted(r.name for r in K.backfill_full(queue, entities, records, limit=n)["decisions"].collect())
    assert taken(2) == ["Alpha", "Beta"] and taken(0) == ["Alpha", "Beta", "Zeta"]


def test_embedding_goes_on_where_it_stopped(spark):
    entities = spark.createDataFrame([(k, f"name {k}") for k in (3, 1, 2)], "id long, canonical_name string")
    none = spark.createDataFrame([], "id long, v array<double>, model_version string")
    encode = lambda df, c: df.selectExpr("*", "array(CAST(id AS DOUBLE)) AS v")
    one = K.embed_pending(entities, none, "m", encode, max_rows=2)
    assert sorted(r.id for r in one.collect()) == [1, 2]
    assert sorted(r.id for r in K.embed_pending(entities, one, "m", encode, max_rows=2).collect()) == [1, 2, 3]


def test_what_nothing_refreshes_is_an_error(spark, tmp_path):
    base = {"f": spark.range(3)}
    both = {"a": (("f",), lambda r: r["f"]), "b": (("a",), lambda r: r["a"])}
    assert rollup_refresh(spark, both, base, str(tmp_path), guard=True) == ["a", "b"]
    assert unrefreshed(spark, {"a": both["a"]}, str(tmp_path)) == ["b"]
    with pytest.raises(ValueError, match="nothing refreshes"):
        rollup_refresh(spark, {"a": both["a"]}, base, str(tmp_path), guard=True)
