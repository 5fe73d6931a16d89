"""Filings are a join of five tables: a query that needs them several times joins them once."""

import pytest

from lodestar.operators import classify as C
from lodestar.plans import queries as Q


def _source(df):
    return [f for f in df.inputFiles() if "lineitem" in f]


@pytest.mark.parametrize("table", ["occupation_level", "occupation_top_employer", "occupation_yearly", "employer"])
def test_the_mart_joins_filings_once(spark, sf, table):
    assert not _source(Q.marts(spark, sf)[table])


def test_the_cascade_joins_filings_once(spark, sf):
    assert not _source(Q.cascade(spark, sf))


def test_decisions_join_filings_once(spark, sf):
    records, quarantine = Q._decided_quarantine(spark, sf)
    assert not _source(records) and not _source(quarantine)


def test_known_titles_are_not_counted(spark, sf):
    got = C.bootstrap_aliases(Q.filings(spark, sf), Q.aliases(spark, sf), 1, 1, 0.0)
    assert not _source(got) and got.where("title NOT LIKE 'r%'").count() == 0


def test_the_backfill_joins_filings_once_and_its_statistics_not_at_all(spark, sf, monkeypatch):
    from lodestar.operators import linkage as K

    reads = []
    whole = Q.filings
    monkeypatch.setattr(Q, "stored", lambda df: reads.append(len(_source(df))) or df.localCheckpoint())
    monkeypatch.setattr(K, "cut", lambda df: reads.append(len(_source(df))) or df.localCheckpoint())
    monkeypatch.setattr(Q, "filings", lambda s, d: whole(s, d))
    assert not _source(Q.QUERIES["e06_backfill_stats"](spark, sf)) and not any(reads)
    for name in ("e06_backfill_entities", "e06_backfill_records"):
        reads.clear()
        assert not _source(Q.QUERIES[name](spark, sf)) and sum(reads) == 1
