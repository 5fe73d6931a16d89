"""Faults that were mended: what they were found by stays here."""

import time

import numpy as np
import pytest

from lodestar.llm import html, langid, minhash, quality, secrets


def test_pages_may_hold_the_attribute_of_the_layouts(spark):
    pages = ['<article><p data-y="x">Hello there.</p></article>', '<article><p data-y="12px">Hello there.</p></article>', "<article><p data-y=1>Hello there.</p></article>", "<article><p>Hello there.</p></article>"]
    got = {r.text for r in html.extract(spark.createDataFrame(list(enumerate(pages)), "page_id long, html string")).collect()}
    assert len(got) == 1
    assert all(n.label is None for p in pages for n in html.parse(p)[0])
    assert html.parse('<p data-y="0">a</p>', labelled=True)[0][-1].label == 0


def test_open_inline_elements_before_blocks_take_linear_time():
    start = time.time()
    html.parse("<b>" * 20_000 + "<div>" * 20_000)
    assert time.time() - start < 5


def test_one_labelled_id_on_many_rows_returns_one_score(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(quality, "fit_threshold", lambda good, bad, keep: seen.append(len(good) + len(bad)) or 0.0)
    text = " ".join(f"w{k}" for k in range(40))
    docs = spark.range(4000).selectExpr("CAST(7 AS LONG) AS doc_id", f"concat('{text} ', id) AS text").unionByName(spark.createDataFrame([(8, text)], "doc_id long, text string"))
    labels = spark.createDataFrame([(7, 1, 0), (8, 0, 0), (9, 1, 0)], "doc_id long, quality int, toxic int")
    assert quality.rules(docs, labels).count() == 4001
    assert seen == [2]


def test_too_many_languages_are_refused_before_they_are_collected(spark, monkeypatch):
    rows = spark.range(30).selectExpr("concat('text ', id) AS text", "concat('l', id % 6) AS lang")
    assert len(langid.fit(rows, max_langs=6)[0]) == 6
    monkeypatch.setattr(type(rows), "toPandas", lambda self: pytest.fail("collected"))
    with pytest.raises(ValueError):
        langid.fit(rows, max_langs=5)


def test_columns_named_like_helpers_stay(spark):
    text = "AKIA" + "A1B2" * 5 + " " + " ".join(f"w{k}" for k in range(30))
    docs = spark.createDataFrame([(1, text, "r", "n", "b", "s", "t"), (2, text, "r", "n", "b", "s", "t"), (3, None, None, None, None, None, None)], "doc_id long, text string, _row string, _N string, _blob string, _spans string, score string")
    one = minhash.deduplicated(docs)
    assert one.columns == docs.columns and sorted(r.doc_id for r in one.collect()) == [1, 3]
    clean = secrets.redacted(docs)
    assert sorted(clean.columns) == sorted(docs.columns) and {(r._blob, r._spans, r._row) for r in clean.collect()} == {("b", "s", "r"), (None, None, None)}
    assert all("AKIA" not in (r.text or "") for r in clean.collect())
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = quality.rules(docs, labels, carry=("score", "_row"))
    assert got.columns.count("score") == 1 and dict(got.dtypes)["score"] == "double" and got.where("_row = 'r'").count() == 2


def test_all_labelled_rows_count_and_scores_stay_off_the_driver(spark):
    good, bad = [" ".join(f"fine{k % 7}{j}" for j in range(25)) for k in range(40)], [" ".join(f"junk{k % 5}{j}" for j in range(25)) for k in range(40)]
    rows = list(enumerate(good + bad))
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(i, int(i < 40), 0) for i, _ in rows], "doc_id long, quality int, toxic int")
    kinds = quality.labelled_kinds(spark.range(40_000).selectExpr("id AS doc_id", "1 AS quality", "0 AS toxic"))
    assert kinds.count() == 40_000
    got = {r.doc_id: r for r in quality.rules(docs, labels).collect()}
    assert {i for i, r in got.items() if r.kept} == set(range(40))
    rng = np.random.default_rng(3)
    for n, m in ((1, 1), (700, 900), (5000, 3)):
        x, y = np.round(rng.normal(1, 0.3, n), 6), np.round(rng.normal(0.5, 0.4, m), 6)
        frame = spark.createDataFrame([(1, float(v)) for v in x] + [(0, float(v)) for v in y], "kind int, score double")
        a, b = quality.tallies(frame, 0.99)
        assert (len(a), len(b)) == (n, m) and len(a.values) < 4500
        top, low = np.quantile(x, 1 - 0.99), min(x.min(), y.min())
        cuts = np.arange(np.floor(low * 1000), np.floor(top * 1000) + 1) / 1000
        passed = np.array([(y >= c).sum() for c in cuts])
        best = cuts[passed == passed.min()]
        assert quality.fit_threshold(a, b, 0.99) == quality.fit_threshold(x, y, 0.99) == best[len(best) // 2]


def test_texts_without_a_label_are_not_shuffled(spark):
    texts = spark.range(20000).selectExpr("id - 5000 AS doc_id", "string(id) AS text").unionByName(spark.sql("SELECT CAST(NULL AS BIGINT) AS doc_id, 'x' AS text"))
    kinds = texts.where("doc_id % 7 = 0").selectExpr("doc_id", "1 AS kind")
    got = quality.maybe_labelled(texts, kinds)
    assert got.where("doc_id % 7 = 0").count() == kinds.count()
    assert got.where("doc_id IS NULL OR doc_id % 7 <> 0").count() < 20
    assert quality.maybe_labelled(texts, kinds.limit(0)).count() == 0
    same = quality.maybe_labelled(texts, kinds.selectExpr("int(doc_id) AS doc_id", "kind")).join(kinds, "doc_id")
    assert same.count() == kinds.count()


@pytest.mark.parametrize("one_task", [500_000, 0])
def test_near_dedup_sends_no_table_through_the_driver(spark, monkeypatch, one_task):
    from lodestar.llm import graph

    plans = []
    plan = lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString())
    for module in (minhash, graph):
        whole = module.cut
        monkeypatch.setattr(module, "cut", lambda df, whole=whole: (whole(df), plan(df))[0])
    monkeypatch.setattr(minhash, "components", lambda *a, **k: graph.components(*a, **k, one_task=one_task))
    words = [f"w{k}" for k in range(60)]
    texts = [" ".join([*words[: 40 + i], *(f"x{j}" for j in range(i % 7))]) for i in range(20)] + [" ".join(f"y{i}{k}" for k in range(40)) for i in range(10)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for out in (minhash.deduplicated(docs, rounds=1), minhash.near_duplicates(docs, rounds=1)):
        assert 10 < out.count() <= 30
        plan(out)
    assert len(plans) > 20 and any("SortMergeJoin" in p for p in plans) and not any("Broadcast" in p for p in plans)
