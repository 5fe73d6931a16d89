"""Discovery, header normalization, validation, and year-partitioned writing of filings."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestar.functions.scalar import valid_fein

from .scratch import cut


def extract_links(pages: DataFrame, suffix: str, base: str) -> DataFrame:
    """(page_id, url, file_name) of links that end in suffix in any case; relative ones are made absolute."""
    hrefs = F.expr("""regexp_extract_all(html, 'href="([^"]*)"', 1)""")
    links = pages.select("page_id", F.explode(hrefs).alias("href")).where(F.lower("href").endswith(suffix.lower()))
    url = F.when(F.col("href").rlike("^https?://"), F.col("href")).otherwise(F.concat(F.lit(base.rstrip("/")), F.when(F.col("href").startswith("/"), "").otherwise(F.lit("/")), "href"))
    return links.select("page_id", url.alias("url")).withColumn("file_name", F.element_at(F.split("url", "/"), -1))


def require_links(links: DataFrame) -> DataFrame:
    """The links themselves; an error if there is none at all, which means that the pages have changed."""
    if links.isEmpty():
        raise ValueError("no page has a link of the kind that is looked for")
    return links


def scope_files(links: DataFrame, pattern: str, start_year: int) -> DataFrame:
    """Names that match, from start_year on; the quarter is the fourth unless the name says otherwise."""
    year = F.regexp_extract("file_name", pattern, 1).try_cast("int")
    quarter = F.coalesce(F.regexp_extract("file_name", "_Q([1-4])", 1).try_cast("int"), F.lit(4))
    return links.withColumns({"filing_year": year, "quarter": quarter}).where(F.col("filing_year") >= start_year)


def latest_per_year(files: DataFrame) -> DataFrame:
    w = Window.partitionBy("filing_year").orderBy(F.desc("quarter"), "file_name")
    return files.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")


def plan_ingest(files: DataFrame, ledger: DataFrame, record_years: DataFrame, supersede_untracked: bool = False) -> DataFrame:
    """What to do with each candidate: already_harvested, older, untracked_existing or enqueue (with supersede)."""
    seen = ledger.select("url", F.lit(True).alias("_seen")).distinct()
    last = ledger.groupBy("filing_year").agg(F.max("quarter").alias("_last"))
    has = record_years.select("filing_year", F.lit(True).alias("_has")).distinct()
    j = files.join(seen, "url", "left").join(last, "filing_year", "left").join(has, "filing_year", "left")
    action = F.when(F.col("_seen"), "already_harvested").when(F.col("_has") & F.col("_last").isNull() & F.lit(not supersede_untracked), "untracked_existing").when(F.col("quarter") <= F.col("_last"), "older").otherwise("enqueue")
    return j.withColumn("action", action).withColumn("supersede", (F.col("action") == "enqueue") & F.coalesce("_has", F.lit(False))).drop("_seen", "_last", "_has")


def ledger_append(ledger: DataFrame, new: DataFrame) -> DataFrame:
    return ledger.unionByName(new.dropDuplicates(["url"]).join(ledger, "url", "left_anti").select(*ledger.columns))


def files_by_year(paths: DataFrame) -> DataFrame:
    year = F.regexp_extract("path", "FY(20[0-9]{2})", 1)
    return paths.groupBy(F.when(year == "", "unknown").otherwise(year).alias("year")).agg(F.array_sort(F.collect_list("path")).alias("paths"))


def read_filings(spark: SparkSession, path: str, kind: str, year: int) -> DataFrame:
    """A table with a header row; rows without any value are left out; tagged with file and year."""
    reader = spark.read.option("header", True) if kind == "csv" else spark.read
    df = reader.format(kind).load(path)
    full = F.coalesce(*[F.col(f"`{c}`").cast("string") for c in df.columns]).isNotNull()
    return df.where(full).select("*", F.col("_metadata.file_name").alias("_source_file"), F.lit(year).alias("_filing_year"))


def with_record_ids(df: DataFrame, keys: list[str], out: str = "_nlp_id") -> DataFrame:
    return df.withColumn(out, F.sha2(F.concat_ws("|", *[F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys]), 256))


def _by_year(df: DataFrame, first: int, last: int) -> DataFrame:
    part = F.when(F.col("filing_year").between(first, last), F.col("filing_year").cast("string")).otherwise("overflow")
    return df.withColumn("part_year", part)


def write_records(df: DataFrame, path: str, first: int = 2000, last: int = 2100, mode: str = "append") -> None:
    """Parquet by year; years out of range, and rows without one, go to one overflow partition."""
    _by_year(df, first, last).write.mode(mode).partitionBy("part_year").parquet(path)


def supersede_year(df: DataFrame, path: str, first: int = 2000, last: int = 2100) -> None:
    """Replace the rows of the years in df; all other years stay, those that share the overflow partition among them."""
    spark, new = df.sparkSession, _by_year(df, first, last)
    outside = new.where("part_year = 'overflow'")
    if not outside.isEmpty():
        # The partition is read and overwritten in one job, so what stays is cut off from its files first.
        years = outside.select(F.col("filing_year").alias("_y")).distinct()
        old = spark.read.parquet(path).where("part_year = 'overflow'")
        stays = cut(old.join(years, F.col("filing_year").eqNullSafe(F.col("_y")), "left_anti"))
        new = new.unionByName(stays, allowMissingColumns=True)
    new.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part_year").parquet(path)


#: Older names of the canonical keys, in the order in which they are tried.
ALIASES = (
    ("WORKSITE_CITY_1", "WORKSITE_CITY"),
    ("WORKSITE_STATE_1", "WORKSITE_STATE"),
    ("WAGE_RATE_OF_PAY_FROM_1", "WAGE_RATE_OF_PAY_FROM"),
    ("WAGE_UNIT_OF_PAY_1", "WAGE_UNIT_OF_PAY"),
    ("PREVAILING_WAGE_1", "PREVAILING_WAGE"),
    ("PW_UNIT_OF_PAY_1", "PW_UNIT_OF_PAY"),
    ("PW_WAGE_LEVEL_1", "PW_WAGE_LEVEL"),
    ("SOC_NAME", "SOC_TITLE"),
    ("NAIC_CODE", "NAICS_CODE"),
    ("WAGE_RATE_OF_PAY", "WAGE_RATE_OF_PAY_FROM"),
    ("STATUS", "CASE_STATUS"),
    ("LCA_CASE_EMPLOYER_NAME", "EMPLOYER_NAME"),
    ("LCA_CASE_EMPLOYER_CITY", "EMPLOYER_CITY"),
    ("LCA_CASE_EMPLOYER_STATE", "EMPLOYER_STATE"),
    ("LCA_CASE_JOB_TITLE", "JOB_TITLE"),
    ("LCA_CASE_SOC_CODE", "SOC_CODE"),
    ("LCA_CASE_SOC_NAME", "SOC_TITLE"),
    ("LCA_CASE_NAICS_CODE", "NAICS_CODE"),
    ("LCA_CASE_WAGE_RATE_FROM", "WAGE_RATE_OF_PAY_FROM"),
    ("LCA_CASE_WAGE_RATE_UNIT", "WAGE_UNIT_OF_PAY"),
    ("LCA_CASE_WORKLOC1_CITY", "WORKSITE_CITY"),
    ("LCA_CASE_WORKLOC1_STATE", "WORKSITE_STATE"),
    ("WORK_LOCATION_CITY1", "WORKSITE_CITY"),
    ("WORK_LOCATION_STATE1", "WORKSITE_STATE"),
    ("PW_1", "PREVAILING_WAGE"),
    ("PW_UNIT_1", "PW_UNIT_OF_PAY"),
)


def apply_aliases(df: DataFrame, doc: str = "doc", year: str = "filing_year", aliases: tuple[tuple[str, str], ...] = ALIASES, cutoff: int = 2020) -> DataFrame:
    """doc (a map) with canonical keys added for years before the cutoff: the first alias that is there, if the key is not.

    A key that is there with null is there. Originals stay. _schema_era and _aliases_applied say what was done.
    """
    has = lambda k: F.array_contains(F.map_keys(doc), k)
    old = F.coalesce(F.col(year) < cutoff, F.lit(False))
    by_target: dict[str, list[str]] = {}
    for source, target in aliases:
        by_target.setdefault(target, []).append(source)
    entries, names = [], []
    for target, sources in by_target.items():
        value, name = None, None
        for s in reversed(sources):
            value = F.when(has(s), F.try_element_at(doc, F.lit(s))) if value is None else F.when(has(s), F.try_element_at(doc, F.lit(s))).otherwise(value)
            name = F.when(has(s), F.lit(f"{s}->{target}")) if name is None else F.when(has(s), F.lit(f"{s}->{target}")).otherwise(name)
        fires = old & ~has(target) & name.isNotNull()
        entries.append(F.when(fires, F.struct(F.lit(target).alias("k"), value.alias("v"))))
        names.append(F.when(fires, name))
    added = F.map_from_entries(F.array_compact(F.array(*entries)))
    return df.withColumns({doc: F.map_concat(doc, added), "_aliases_applied": F.array_compact(F.array(*names)), "_schema_era": F.when(old, "pre").otherwise("native")})


def header_report(headers: DataFrame, canonical: list[str], aliases: tuple[tuple[str, str], ...] = ALIASES) -> DataFrame:
    """Per file: how many headers are canonical and have an alias, and the names of unknown headers and of missing canonical ones."""
    known = F.col("header").isin(canonical)
    alias = F.col("header").isin([a for a, _ in aliases])
    odd = F.array_sort(F.collect_set(F.when(~alias & ~known, F.col("header"))))
    agg = headers.groupBy("file").agg(F.count_if(known).alias("recognized"), F.count_if(alias & ~known).alias("aliased"), odd.alias("unknown"), F.collect_set("header").alias("_h"))
    return agg.withColumn("missing", F.array_sort(F.array_except(F.array(*map(F.lit, canonical)), "_h"))).drop("_h")


def validate_records(df: DataFrame, mode: str = "row") -> tuple[DataFrame, DataFrame]:
    """(valid, invalid with errors): state upper-cased, bad ids nulled, bounds and duplicate ids checked. mode batch rejects the
    whole batch of a bad row."""
    state = F.upper("employer_state")
    dup = F.count("*").over(Window.partitionBy("batch_id", "id")) > 1
    rules: dict[str, Column] = {
        "duplicate_id": dup, "year_out_of_range": ~F.coalesce(F.col("filing_year").between(2000, 2100), F.lit(False)),
        "title_too_long": F.coalesce(F.length("job_title") > 500, F.lit(False)), "state_length": F.coalesce(F.length("employer_state") != 2, F.lit(False)),
    }
    errors = F.array_compact(F.array(*[F.when(bad, F.lit(name)) for name, bad in rules.items()]))
    out = df.withColumn("errors", errors).withColumns({"employer_state": state, "fein": F.when(valid_fein(F.col("fein")), F.col("fein"))})
    bad = F.size("errors") > 0
    if mode == "batch":
        bad = F.max(bad).over(Window.partitionBy("batch_id"))
    out = out.withColumn("_bad", bad)
    return out.where("NOT _bad").drop("_bad", "errors"), out.where("_bad").drop("_bad")


def coverage_sweep(records: DataFrame, quarantine: DataFrame, key: str = "record_id") -> DataFrame:
    return records.where("soc_code IS NULL").join(quarantine, key, "left_anti")


def assert_coverage(records: DataFrame, quarantine: DataFrame, most: int = 500, warn_only: bool = False) -> int:
    n = coverage_sweep(records, quarantine).count()
    if n > most and not warn_only:
        raise ValueError(f"{n} records are neither classified nor quarantined; at most {most} may be")
    return n


def export_json_lines(df: DataFrame) -> DataFrame:
    return df.select(F.base64(F.to_json(F.struct("*")).cast("binary")).alias("line"))


def import_json_lines(lines: DataFrame, schema: str) -> DataFrame:
    return lines.select(F.from_json(F.unbase64("line").cast("string"), schema).alias("r")).select("r.*")


def join_case_files(cases: DataFrame, worksites: DataFrame, key: str, appendix: DataFrame | None = None) -> DataFrame:
    """One row per case with its worksites nested, in order, and with its wage attestations if an appendix is given."""
    for name, rows in (("worksites", worksites), ("attestations", appendix)):
        if rows is not None:
            nested = rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*[c for c in rows.columns if c != key]))).alias(name))
            cases = cases.join(nested, key, "left")
    return cases


def write_mart(frames: dict[str, DataFrame], path: str, label: str) -> None:
    for name, df in frames.items():
        df.write.mode("overwrite").parquet(f"{path}/label={label}/{name}")


def read_mart(spark: SparkSession, path: str, label: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{path}/label={label}/{name}")


def mart_labels(spark: SparkSession, path: str, name: str) -> list[str]:
    """The labels under which a mart table was published, newest first."""
    files = spark.read.parquet(f"{path}/label=*/{name}").select(F.regexp_extract("_metadata.file_path", "/label=([^/]+)/", 1).alias("label")).distinct()
    return [r.label for r in files.orderBy(F.desc("label")).collect()]


def nlp_projection(df: DataFrame, fields: list[str], doc: str = "doc") -> DataFrame:
    """The classifier's inputs from a map: the upper-case key, else the lower-case one, else the empty string."""
    return df.withColumns({k.lower(): F.coalesce(F.try_element_at(doc, F.lit(k.upper())), F.try_element_at(doc, F.lit(k.lower())), F.lit("")) for k in fields})


#: Fixed values: (code, title of the code, job title) headers of the dictionary's editions, and words that mark the header row.
LAYOUTS = (
    ("2018 SOC Code", "2018 SOC Title", "2018 SOC Direct Match Title"), ("2018 SOC Code", "2018 SOC Title", "2018 Direct Match Title"),
    ("SOC Code", "SOC Title", "Direct Match Title"),
)
HEADER_WORDS = ("soc code", "direct match title", "soc title")


def load_dictionary(rows: DataFrame) -> DataFrame:
    """(job_title, soc_code, soc_title) of sheet rows (idx from 0, cells). Only the first 20 rows are read to find the header.

    Rows without one of the values go; of titles that are equal in lower case the first row stays.
    """
    head = sorted(rows.where("idx < 20").collect(), key=lambda r: r.idx)
    marks = [r for r in head if any(w in (c or "").lower() for c in r.cells for w in HEADER_WORDS)]
    names = [(c or "").strip() for c in (marks or head)[0].cells] if head else []
    layout = next((x for x in LAYOUTS if set(x) <= set(names)), None)
    if layout is None:
        raise ValueError(f"unknown columns {sorted(names)}; one of {LAYOUTS} is needed")
    cell = lambda name: F.trim(F.try_element_at("cells", F.lit(names.index(name) + 1)))
    body = rows.where(F.col("idx") > (marks or head)[0].idx).select("idx", *[cell(name).alias(out) for name, out in zip(layout, ("soc_code", "soc_title", "job_title"), strict=True)]).dropna()
    first = body.groupBy(F.lower("job_title").alias("_key")).agg(F.min_by(F.struct("job_title", "soc_code", "soc_title"), "idx").alias("r"))
    return first.select("r.*")


def classify_jsonl(spark: SparkSession, src: str, dst: str, classify: Callable[[DataFrame], DataFrame], field: str = "job_title") -> None:
    """JSON lines in, JSON lines out with what classify adds; field names the title."""
    rows = spark.read.json(src)
    classify(rows if field == "job_title" else rows.withColumnRenamed(field, "job_title")).write.mode("overwrite").json(dst)
