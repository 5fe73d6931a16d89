"""The `filings` frame and small frames beside it, projected from the provided star-schema tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: One text for both engines (FIXTURES.md, section 3).
FILINGS_SQL = """
SELECT
  concat(CAST(l.l_orderkey AS STRING),'-',CAST(l.l_partkey AS STRING),'-',CAST(l.l_suppkey AS STRING),'-',CAST(l.l_linenumber AS STRING)) AS record_id,
  CAST(year(o.o_orderdate) AS INT) AS filing_year,
  CASE WHEN l.l_returnflag = 'N' THEN 'Certified'
       WHEN l.l_returnflag = 'R' AND l.l_linestatus = 'O' THEN 'Certified'
       WHEN l.l_returnflag = 'R' THEN 'Denied'
       WHEN l.l_linestatus = 'F' THEN 'Withdrawn'
       ELSE 'Certified - Withdrawn' END AS case_status,
  c.c_name AS employer_name,
  substr('CATXNYNJWAILMAPAGAFLVANCOHMIMDCOAZCTMNINMOTNWIORUT', c.c_nationkey*2+1, 2) AS employer_state,
  CASE WHEN o.o_custkey % 4 = 0 THEN NULL
       ELSE concat(lpad(CAST(o.o_custkey % 90 + 10 AS STRING),2,'0'),'-',lpad(CAST(o.o_custkey AS STRING),7,'0')) END AS employer_fein,
  CASE WHEN o.o_custkey % 25 = 0 THEN NULL ELSE CAST(o.o_custkey AS STRING) END AS canonical_employer_id,
  p.p_name AS job_title,
  CASE WHEN l.l_linenumber = 7 THEN '13-1111'
       ELSE concat('15-', CAST(1000 + length(p.p_name)*10 + ascii(p.p_name) % 10 AS STRING), '.00') END AS filed_soc_code,
  concat(p.p_type, ' WORKERS') AS filed_soc_title,
  CASE WHEN p.p_size = 50 THEN NULL
       ELSE concat('15-', CAST(1000 + CAST(replace(p.p_brand,'Brand#','') AS INT) AS STRING)) END AS soc_code,
  CASE WHEN p.p_size = 50 THEN NULL WHEN l.l_discount <= 0.021 THEN 'dmtf'
       WHEN l.l_discount <= 0.041 THEN 'employer_consensus' ELSE 'stage2' END AS soc_source,
  CASE WHEN p.p_size = 50 THEN NULL WHEN l.l_discount <= 0.021 THEN CAST(1.0 AS DOUBLE)
       ELSE CAST(100 - 5*CAST(round(l.l_discount*100) AS INT) AS DOUBLE)/CAST(100 AS DOUBLE) END AS soc_confidence,
  CASE c.c_mktsegment WHEN 'MACHINERY' THEN '333111' WHEN 'FURNITURE' THEN '442110' WHEN 'BUILDING' THEN '236115'
       WHEN 'AUTOMOBILE' THEN '541511' ELSE '6' END AS naics_code,
  CASE l.l_linenumber WHEN 1 THEN 'I' WHEN 2 THEN 'II' WHEN 3 THEN 'III' WHEN 4 THEN 'IV' WHEN 5 THEN 'Level II' END AS pw_wage_level,
  CASE l.l_linenumber WHEN 1 THEN 'Year' WHEN 2 THEN 'Hour' WHEN 3 THEN 'Week' WHEN 4 THEN 'Month' WHEN 5 THEN 'Bi-Weekly' WHEN 7 THEN 'Day' END AS wage_unit_of_pay,
  CASE l.l_linenumber WHEN 2 THEN CAST(CAST(l.l_quantity AS INT) AS STRING)
       WHEN 3 THEN CAST(l.l_partkey % 2000 + 100 AS STRING)
       WHEN 4 THEN CAST((l.l_partkey*7 + l.l_suppkey) % 9000 + 500 AS STRING)
       WHEN 5 THEN concat('1,', lpad(CAST(l.l_orderkey % 1000 AS STRING),3,'0'), '.50')
       WHEN 6 THEN concat(CAST(CAST(l.l_extendedprice AS DECIMAL(12,2)) AS STRING), ' - 999999')
       ELSE CAST(CAST(l.l_extendedprice AS DECIMAL(12,2)) AS STRING) END AS wage_rate_of_pay_from,
  'Year' AS pw_unit_of_pay,
  CAST(p.p_size*1500 + 20000 AS STRING) AS prevailing_wage,
  concat('City ', CAST(s.s_suppkey % 7 AS STRING)) AS worksite_city,
  substr('CATXNYNJWAILMAPAGAFLVANCOHMIMDCOAZCTMNINMOTNWIORUT', s.s_nationkey*2+1, 2) AS worksite_state
FROM {lineitem} l JOIN {orders} o ON l.l_orderkey = o.o_orderkey
JOIN {customer} c ON c.c_custkey = o.o_custkey
JOIN {part} p ON p.p_partkey = l.l_partkey
JOIN {supplier} s ON s.s_suppkey = l.l_suppkey
"""
ENTITIES_SQL = """
SELECT CAST(c_custkey AS STRING) AS id, c_name AS canonical_name,
  substr('CATXNYNJWAILMAPAGAFLVANCOHMIMDCOAZCTMNINMOTNWIORUT', c_nationkey*2+1, 2) AS employer_state,
  CASE WHEN c_custkey % 4 = 0 THEN NULL
       ELSE concat(lpad(CAST(c_custkey % 90 + 10 AS STRING),2,'0'),'-',lpad(CAST(c_custkey AS STRING),7,'0')) END AS fein
FROM {customer}
"""
ALIASES_SQL = """
SELECT p_name AS job_title, min(concat('15-', CAST(1000 + CAST(replace(p_brand,'Brand#','') AS INT) AS STRING))) AS soc_code,
  'seed' AS source FROM {part} WHERE p_name NOT LIKE 'r%' GROUP BY p_name
"""
_TABLES = ("lineitem", "orders", "customer", "part", "supplier")


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _sql(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    return spark.sql(text, **{t: read(spark, sf_dir, t) for t in _TABLES if "{%s}" % t in text})


def filings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sql(spark, sf_dir, FILINGS_SQL)


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sql(spark, sf_dir, ENTITIES_SQL)


def aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sql(spark, sf_dir, ALIASES_SQL)


def with_filings(sql: str) -> str:
    """An oracle over the frames that it names."""
    names = {t: t for t in _TABLES}
    frames = {"filings": FILINGS_SQL, "entities": ENTITIES_SQL, "aliases": ALIASES_SQL}
    wages = WAGED_SQL if "waged" in sql else ""
    used = [k for k in frames if k in sql or (k == "filings" and wages)]
    ctes = [f"{k} AS ({frames[k].format(**names)})" for k in used] + ([f"waged AS ({wages})"] if wages else [])
    sql = sql.strip()
    joiner = ", " + sql[5:] if sql.upper().startswith("WITH ") else " " + sql
    return f"WITH {', '.join(ctes)}{joiner}" if ctes else sql


_N = "TRY_CAST(nullif(regexp_extract(replace({0}, ',', ''), '[0-9]+([.][0-9]+)?', 0), '') AS DOUBLE)"
_A = "CASE upper(coalesce({1}, 'Year')) WHEN 'YEAR' THEN 1 WHEN 'HOUR' THEN 2080 WHEN 'WEEK' THEN 52 WHEN 'MONTH' THEN 12 WHEN 'BI-WEEKLY' THEN 26 END"
WAGED_SQL = f"SELECT *, {_N.format('wage_rate_of_pay_from')} * {_A.format('', 'wage_unit_of_pay')} AS wage, {_N.format('prevailing_wage')} * {_A.format('', 'pw_unit_of_pay')} AS pw FROM filings"
