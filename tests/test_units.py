"""Literal fixtures: wages, identifiers, trigrams, aliases, streams, partitions."""

import pytest
from pyspark.sql import functions as F

from lodestar.functions import scalar as S
from lodestar.operators import linkage as K
from lodestar.operators import serving as V
from lodestar.operators import upsert as U
from lodestar.sources import ingest as I
from lodestar.streaming import jobs as X


def one(spark, col):
    return spark.range(1).select(col).first()[0]


@pytest.mark.parametrize(
    ("amount", "unit", "want"),
    [("110000", "Year", 110000), ("52.50", "Hour", 109200), ("1,500", "Week", 78000), ("8000", " Month", None), ("4000", "bi-weekly", 104000), ("90000", None, 90000), ("500", "Day", None), ("$1,200.50 - 1300", "Year", 1200.5), ("", "Year", None)],
)
def test_wages(spark, amount, unit, want):
    assert one(spark, S.annualize(S.first_number(F.lit(amount)), F.lit(unit).cast("string"))) == want


def test_strip_number(spark):
    assert one(spark, S.strip_number(F.lit("$1,200.50 - 1300"))) == 1200.501300


def test_feins(spark):
    for s, strict, lax in (("12-3456789", True, True), ("123456789", False, True), ("12-345678", False, True), ("", False, False), (None, False, False)):
        assert one(spark, S.valid_fein(F.lit(s).cast("string"))) is strict
        assert one(spark, S.valid_fein(F.lit(s).cast("string"), False)) is lax


def test_trigram_probes(spark):
    sim = lambda a, b: round(one(spark, S.trigram_similarity(F.lit(a), F.lit(b))), 2)
    assert sim("Apple Inc", "Apple Inc.") == 1.0
    assert sim("BYTEDANCE INC.", "ByteDance Inc.") == 1.0
    assert sim("Goggle Inc", "GOFO Inc.") == sim("GOFO Inc.", "Goggle Inc") == 0.43


def test_aliases(spark):
    docs = [(2019, {"PREVAILING_WAGE_1": "old", "PREVAILING_WAGE": "already"}), (2019, {"NAIC_CODE": "541511", "WAGE_RATE_OF_PAY": "120000"}), (2020, {"NAIC_CODE": "1"}), (2018, {"SOC_NAME": "x", "SOC_TITLE": None}), (None, {"NAIC_CODE": "1"})]
    got = I.apply_aliases(spark.createDataFrame(docs, "filing_year int, doc map<string,string>")).collect()
    assert got[0].doc["PREVAILING_WAGE"] == "already" and got[0]._aliases_applied == []
    assert got[1].doc["NAICS_CODE"] == "541511" and got[1].doc["WAGE_RATE_OF_PAY_FROM"] == "120000" and got[1].doc["NAIC_CODE"] == "541511"
    assert got[2].doc == {"NAIC_CODE": "1"} and got[2]._schema_era == "native"
    assert got[3].doc["SOC_TITLE"] is None
    assert got[4]._schema_era == "native"


def test_json_null_is_a_key(spark):
    assert one(spark, S.has_key(F.lit('{"a": null}'), "a")) and not one(spark, S.has_key(F.lit('{"a": null}'), "b"))


def test_prefix_filter_equals_brute_force(spark):
    names = spark.createDataFrame([(k, n) for k, n in enumerate(["Acme Corp", "ACME Corp.", "Acme Corporation", "Zeta Labs", "Zeta Lab", "", "ß é", "Acme Corp"])], "id long, name string")
    got = {(r.left_id, r.right_id) for r in K.set_similarity_join(names, names, 0.6).collect()}
    a = names.select(F.col("id").alias("a"), S.trigrams(F.col("name")).alias("x"))
    b = names.select(F.col("id").alias("b"), S.trigrams(F.col("name")).alias("y"))
    assert got == {(r.a, r.b) for r in a.join(b).where(S.jaccard(F.col("x"), F.col("y")) >= 0.6).collect()}


def test_knn_blocks_agree(spark, sf):
    e = spark.read.parquet(f"{sf}/embeddings.parquet").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    q = e.where("id % 5 = 0")
    assert sorted(map(tuple, K.nearest_vectors(q, e, 2).collect())) == sorted(map(tuple, K.nearest_vectors(q, e, 2, block=3, chunk=7).collect()))


def test_knn_meets_every_other_row(spark, sf):
    from lodestar.plans import queries as Q

    e = {r.vec_id: [float(x) for x in r.embedding] for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()}
    cos = lambda a, b: round(sum(x * y for x, y in zip(a, b, strict=True)) / (sum(x * x for x in a) * sum(x * x for x in b)) ** 0.5, 5)
    got = Q.QUERIES["j10_knn_all_rows"](spark, sf).collect()
    asked = sorted({r.query_id for r in got})[:10]
    for q in asked:
        want = sorted((cos(e[q], v) for k, v in e.items() if k != q), reverse=True)[:3]
        assert [round(r.sim, 5) for r in sorted(got, key=lambda r: r["rank"]) if r.query_id == q] == pytest.approx(want, abs=2e-5)
    assert {r.query_id for r in got} == {k for k in e if k % 20 == 0} and any(r.base_id % 10 == 0 for r in got)


def test_similar_texts_meets_all_pairs(spark, sf):
    from lodestar.plans import queries as Q

    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(60).collect()
    long = " ".join(f"word{k * 7919 % 1009}" for k in range(200))
    rows = [(r.doc_id, r.text) for r in docs] + [(9001, long), (9027, long + " end"), (9003, long.upper()), (9003, long + "!"), (None, long), (9004, ""), (9005, None), (9006, long[:900])]
    frame = spark.createDataFrame(rows, "id long, name string")
    grams = [set(r.g) if r.g else set() for r in frame.select(S.trigrams(F.col("name")).alias("g")).collect()]
    links = [sum(1 for j, b in enumerate(grams) if j != i and a and b and len(a & b) / len(a | b) >= 0.85) for i, a in enumerate(grams)]
    out = K.similarity_classes(frame, 0.85).collect()
    key = lambda x: (x[0] is None, x[0] or 0, x[1])
    assert sorted([(r.id, r.links) for r in out], key=key) == sorted([(r[0], n) for r, n in zip(rows, links, strict=True)], key=key)
    assert len({r.class_id for r in out if r.id in (9001, 9003)}) == 1 and max(links) >= 4
    assert Q.QUERIES["j09_similar_texts"](spark, sf).count() == spark.read.parquet(f"{sf}/documents.parquet").count()


def test_embed_norm(spark):
    v = K.embed(spark.createDataFrame([("Acme",)], "name string"), "name").first().v
    assert len(v) == 64 and 0.95 < sum(x * x for x in v) ** 0.5 < 1.05


def test_decisions(spark):
    rec = spark.createDataFrame([(k, "15-1111", 0.5, "stage2", True) for k in range(4)], "id int, soc_code string, soc_confidence double, soc_source string, requires_review boolean")
    dec = spark.createDataFrame([(1, 0, "accept", None, 1), (2, 1, "override", "15-2222", 1), (3, 2, "accept", None, 1), (4, 2, "reject", None, 2)], "decision_id int, id int, action string, code string, decided_at int")
    out, gone = U.review_decisions(rec, dec, "id")
    got = {r.id: (r.soc_code, r.soc_source, r.requires_review) for r in out.collect()}
    assert got == {0: ("15-1111", "stage2", False), 1: ("15-2222", "operator", False), 2: (None, None, False), 3: ("15-1111", "stage2", True)}
    assert [r.id for r in gone.collect()] == [2]


def test_supersede_keeps_other_years(spark, tmp_path):
    p = str(tmp_path / "r")
    I.write_records(spark.createDataFrame([(2020, "a"), (2021, "b"), (1900, "c")], "filing_year int, x string"), p)
    I.supersede_year(spark.createDataFrame([(2021, "new")], "filing_year int, x string"), p)
    assert {(r.filing_year, r.x) for r in spark.read.parquet(p).collect()} == {(2020, "a"), (2021, "new"), (1900, "c")}


def test_supersede_inside_the_overflow_partition(spark, tmp_path):
    p = str(tmp_path / "r")
    rows = [(1998, "other"), (1999, "old"), (None, "none"), (2020, "a")]
    I.write_records(spark.createDataFrame(rows, "filing_year int, x string"), p)
    I.supersede_year(spark.createDataFrame([(1999, "new"), (2020, "b")], "filing_year int, x string"), p)
    assert {(r.filing_year, r.x) for r in spark.read.parquet(p).collect()} == {(1998, "other"), (1999, "new"), (None, "none"), (2020, "b")}


def test_alias_families(spark):
    wide = {"PREVAILING_WAGE_1": "95000", "WAGE_RATE_OF_PAY_FROM_1": "110000", "WORKSITE_CITY_1": "Austin", "WORKSITE_STATE_1": "TX", "PW_WAGE_LEVEL_1": "Level II", "WAGE_UNIT_OF_PAY_1": "Year", "PW_UNIT_OF_PAY_1": "Hour"}
    old = {"STATUS": "CERTIFIED", "LCA_CASE_EMPLOYER_NAME": "Acme", "LCA_CASE_WAGE_RATE_FROM": "60000", "LCA_CASE_WAGE_RATE_UNIT": "Year", "LCA_CASE_WORKLOC1_CITY": "Reno", "LCA_CASE_WORKLOC1_STATE": "NV", "PW_1": "50000", "PW_UNIT_1": "Year"}
    got = I.apply_aliases(spark.createDataFrame([(2019, wide), (2012, old), (2010, {"WORK_LOCATION_CITY1": "Reno", "WORK_LOCATION_STATE1": "NV"})], "filing_year int, doc map<string,string>")).collect()
    new = [{k: v for k, v in r.doc.items() if k not in was} for r, was in zip(got, (wide, old, {}), strict=True)]
    assert new[0] == {"PREVAILING_WAGE": "95000", "WAGE_RATE_OF_PAY_FROM": "110000", "WORKSITE_CITY": "Austin", "WORKSITE_STATE": "TX", "PW_WAGE_LEVEL": "Level II", "WAGE_UNIT_OF_PAY": "Year", "PW_UNIT_OF_PAY": "Hour"}
    assert new[1] == {"CASE_STATUS": "CERTIFIED", "EMPLOYER_NAME": "Acme", "WAGE_RATE_OF_PAY_FROM": "60000", "WAGE_UNIT_OF_PAY": "Year", "WORKSITE_CITY": "Reno", "WORKSITE_STATE": "NV", "PREVAILING_WAGE": "50000", "PW_UNIT_OF_PAY": "Year"}
    assert new[2]["WORKSITE_CITY"] == "Reno" and len(I.ALIASES) == 26


def test_answers_and_write_back(spark):
    from lodestar.operators import classify as C

    raw = ['{"choice": 2, "confident": true, "reason": "r"}', 'Sure: {"choice": 1, "confident": true} as asked', "no idea", None, '{"choice": 9, "confident": true}', '{"choice": 1}', "{broken {}"]
    said = C.parse_answers(spark.createDataFrame([(k, r) for k, r in enumerate(raw)], "id int, raw string"), "id")
    assert [tuple(r)[1:3] for r in said.orderBy("id").collect()] == [(2, True), (1, True), (0, False), (0, False), (9, True), (1, False), (0, False)]
    held = spark.createDataFrame([(k, "Cellar Lead" if k == 1 else "Software Engineer II") for k in range(7)], "id int, job_title string")
    ranked = spark.createDataFrame([(k, j, f"15-100{j}", 1.0 - j / 10) for k in range(7) for j in (1, 2)], "id int, rank int, code string, sim double")
    answers = {r.id: (r.choice, r.confident) for r in said.collect()}

    def picker(batches):
        for b in batches:
            b = b.assign(choice=b["id"].map(lambda k: answers[k][0]).astype("int32"), confident=b["id"].map(lambda k: answers[k][1]))
            yield b[["id", "choice", "confident"]]

    out = C.adjudicate(held, ranked, "id", picker)
    got = {r.id: (r.code, r.review_reason, r.resolved) for r in out.collect()}
    assert got[0] == ("15-1002", None, True) and got[1] == ("15-1001", "short_title_pick", True) and all(not got[k][2] for k in (2, 3, 4, 5, 6))
    records = held.select("id", F.lit(None).cast("string").alias("soc_code"), F.lit(None).cast("string").alias("soc_source"))
    after, left = C.write_back(records, held, out, "id")
    assert {r.id: r.soc_code for r in after.where("soc_code IS NOT NULL").collect()} == {0: "15-1002", 1: "15-1001"} and left.count() == 5


def test_compare_names_the_winner(spark):
    from lodestar.operators import serving as V

    rows = spark.createDataFrame([("x", 1.0, 5.0, 2.0), ("y", 3.0, 5.0, 9.0)], "k string, p double, q double, r double")
    got = {r.metric: r.winner for r in V.compare(rows, "k", "x", "y", {"p": "high", "q": "high", "r": "low"}).collect()}
    assert got == {"p": "b", "q": "tie", "r": "a"}


def test_running_counts_and_stream_duplicates(spark, tmp_path):
    src, out = str(tmp_path / "src"), str(tmp_path / "out")
    spark.sql("SELECT 'a' AS k, timestamp'2024-01-01 00:00:00' AS ts UNION ALL SELECT 'a', timestamp'2024-01-01 00:00:05' UNION ALL SELECT 'b', timestamp'2024-01-01 00:00:09'").coalesce(1).write.parquet(src)
    stream = lambda: X.stream_ingest(spark, src, "k string, ts timestamp")
    X.running_counts(stream(), "k", out, str(tmp_path / "c1"), spark).awaitTermination()
    assert {(r.k, r["count"]) for r in spark.read.parquet(out).collect()} == {("a", 2), ("b", 1)}
    X.stream_dedup(stream(), "k", "ts", "1 minute").writeStream.format("parquet").option("path", f"{tmp_path}/d").option("checkpointLocation", f"{tmp_path}/c2").trigger(availableNow=True).start().awaitTermination()
    assert sorted(r.k for r in spark.read.parquet(f"{tmp_path}/d").collect()) == ["a", "b"]


def test_links_and_labels(spark, tmp_path):
    none = spark.createDataFrame([], "page_id long, url string")
    with pytest.raises(ValueError):
        I.require_links(none)
    assert I.require_links(none.union(spark.createDataFrame([(1, "u")], none.schema))).count() == 1
    for label in ("2020-q1", "2020-q3", "2019-q4"):
        I.write_mart({"a": spark.range(2)}, f"{tmp_path}/m", label)
    assert I.mart_labels(spark, f"{tmp_path}/m", "a") == ["2020-q3", "2020-q1", "2019-q4"]
    assert one(spark, S.label_display(F.lit("2020-q3"))) == "Q3 2020" and one(spark, S.state_slug(F.lit("New York"), F.lit("NY"))) == "new-york-ny" and one(spark, S.sector_slug(F.lit("A & B"), F.lit("54"))) == "a-and-b-54"


def test_stream_enrich_once_and_dead_letters(spark, tmp_path):
    src, out, dead = (str(tmp_path / x) for x in ("src", "out", "dead"))
    spark.createDataFrame([("a", 1), ("a", 1), ("b", 2)], "record_id string, v int").coalesce(1).write.parquet(src)
    stream = lambda: X.stream_ingest(spark, src, "record_id string, v int")
    X.stream_enrich(stream(), lambda df: df.withColumn("w", F.col("v") * 2), out, dead, str(tmp_path / "c1")).awaitTermination()
    X.stream_enrich(stream(), lambda df: df.withColumn("w", F.col("v") * 2), out, dead, str(tmp_path / "c2")).awaitTermination()
    assert sorted(r.record_id for r in spark.read.parquet(out).collect()) == ["a", "b"]

    def broken(df):
        raise ValueError("poison")

    X.stream_enrich(stream(), broken, out, dead, str(tmp_path / "c3")).awaitTermination()
    assert spark.read.parquet(dead).first().attempts == 5


def test_rollup_refresh(spark, tmp_path):
    from lodestar.plans.refresh import rollup_refresh

    base = {"f": spark.createDataFrame([("a", 1), ("a", 2), ("b", 2)], "k string, y int")}
    registry = {"total": (("by_k",), lambda r: r["by_k"].selectExpr("sum(n) AS n")), "by_k": (("f",), lambda r: r["f"].groupBy("k").count().withColumnRenamed("count", "n"))}
    assert rollup_refresh(spark, registry, base, str(tmp_path)) == ["by_k", "total"]
    assert spark.read.parquet(f"{tmp_path}/total").collect()[0].n == 3
    with pytest.raises(ValueError):
        rollup_refresh(spark, {"x": (("missing",), lambda r: r["missing"])}, base, str(tmp_path))
    with pytest.raises(KeyError):
        rollup_refresh(spark, {"x": ((), lambda r: r["f"])}, base, str(tmp_path))


def test_load_dictionary_layouts(spark):
    from lodestar.sources.ingest import load_dictionary

    rows = lambda *cells: spark.createDataFrame(list(enumerate(cells)), "idx long, cells array<string>")
    got = load_dictionary(rows(["Edition"], ["2018 SOC Code ", "2018 SOC Title", "2018 Direct Match Title"], ["15-1252", "Developers", " Coder "], ["15-1253", "Testers", "CODER"], ["15-1254", None, "Web"]))
    assert [tuple(r) for r in got.collect()] == [("Coder", "15-1252", "Developers")]
    with pytest.raises(ValueError):
        load_dictionary(rows(["SOC Code", "Other"]))
    with pytest.raises(ValueError):
        load_dictionary(rows().where("false"))


def test_classify_jsonl(spark, tmp_path):
    from lodestar.sources.ingest import classify_jsonl

    spark.createDataFrame([("coder",)], "t string").write.json(f"{tmp_path}/in")
    classify_jsonl(spark, f"{tmp_path}/in", f"{tmp_path}/out", lambda df: df.selectExpr("job_title", "'15-1252' AS code"), "t")
    assert [tuple(r) for r in spark.read.json(f"{tmp_path}/out").select("job_title", "code").collect()] == [("coder", "15-1252")]


def test_files_in_and_out(spark, tmp_path):
    src = spark.createDataFrame([("r1", 1999, None), ("r2", 2020, "15-1252"), ("r3", 2021, None)], "record_id string, filing_year int, soc_code string")
    I.write_records(src, f"{tmp_path}/w")
    got = spark.read.parquet(f"{tmp_path}/w")
    assert {(r.record_id, str(r.part_year)) for r in got.collect()} == {("r1", "overflow"), ("r2", "2020"), ("r3", "2021")}
    src.union(spark.createDataFrame([(None, None, None)], src.schema)).write.option("header", True).csv(f"{tmp_path}/c")
    read = I.read_filings(spark, f"{tmp_path}/c", "csv", 2020)
    assert read.count() == 3 and {r._filing_year for r in read.collect()} == {2020}
    none = spark.createDataFrame([], "record_id string")
    assert I.assert_coverage(src, none) == 2 and I.assert_coverage(src, none, 1, warn_only=True) == 2
    with pytest.raises(ValueError):
        I.assert_coverage(src, none, 1)
    I.write_mart({"a": src}, f"{tmp_path}/m", "2020-q1")
    assert I.read_mart(spark, f"{tmp_path}/m", "2020-q1", "a").count() == 3


def test_slugs_fold_letters_and_marks(spark):
    rows = [("Žižkov Ltd",), ("Łódź & Söhne",), ("Café ＡＢＣ１",), ("ŐRSÉG",), ("  --  ",), (None,)]
    got = [r.s for r in spark.createDataFrame(rows, "n string").select(S.slugify(F.col("n")).alias("s")).collect()]
    assert got == ["zizkov-ltd", "odz-and-sohne", "cafe-abc1", "orseg", "", None]


def test_short_codes_number_collisions(spark):
    rows = [("a", "Acme Inc"), ("b", "ACME-Corp"), ("c", "acme!"), ("d", None), ("e", "Bolt")]
    got = {r.k: r.code for r in S.short_codes(spark.createDataFrame(rows, "k string, n string"), "n", "k").collect()}
    assert got == {"a": "ACME", "b": "ACMECORP", "c": "ACME·2", "d": None, "e": "BOLT"}


def test_kpis_of_nothing(spark):
    none = spark.createDataFrame([], "k string, filing_year int, filings long")
    assert tuple(V.entity_kpis(none, "k").first()) == (0, 0, None, None, None)
