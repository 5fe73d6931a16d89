r"""Secret scans through an incremental blob ledger. Native: DataFrame expressions only.

A blob is one version of a text, addressed by its SHA-256. The ledger holds (blob, rule_version, spans): what was scanned by
which version of the rules, and what was found. A scan takes only blobs that the ledger doesn't have under the rules' present
version, so that copies and versions known from earlier runs cost nothing, and joins the findings back to every path.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, table, unused


@dataclass(frozen=True)
class Rule:
    """kind; pattern: the runs to look at, left to right without overlap; least: characters that `group` of a run must have."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1


#: The three base kinds. `{n,}` on a whole run finds the runs of n or more that the pattern with + and a length test finds.
BASE = (
    Rule("assign", r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 6),
    Rule("access", r"AKIA[A-Z0-9]{16,}"),
    Rule("hex", r"[0-9a-f]{24,}"),
)
#: Kinds beyond the base: formats that announce themselves.
MORE = (
    Rule("pem", r"-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----"),
    Rule("forge", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
)
SPAN = "array<struct<start:bigint,ord:int,kind:string,stop:bigint>>"


def spans(text: Column, rule: Rule, order: int) -> Column:
    """Spans of one rule in code points: lengths of the pieces between matches and of the matches, summed from the left."""
    p = F.lit(rule.pattern)
    runs, gaps = F.regexp_extract_all(text, p, F.lit(0)), F.split(text, rule.pattern, -1)
    good = F.transform(F.regexp_extract_all(text, p, F.lit(rule.group)), lambda g: F.length(g) >= rule.least)
    steps = F.arrays_zip(F.slice(gaps, F.lit(1), F.size(runs)).alias("g"), runs.alias("r"), good.alias("ok"))

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["g"])
        stop = start + F.length(x["r"])
        one = F.array(F.struct(start.alias("start"), F.lit(order).alias("ord"), F.lit(rule.kind).alias("kind"), stop.alias("stop")))
        return F.struct(stop.alias("at"), F.when(x["ok"], F.concat(acc["found"], one)).otherwise(acc["found"]).alias("found"))

    none = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast(SPAN).alias("found"))
    found = F.aggregate(steps, none, step, lambda acc: acc["found"])
    return F.when(F.rlike(text, p), found).otherwise(F.array().cast(SPAN))


def joined(found: Column) -> Column:
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")


def scan(docs: DataFrame, rules: tuple[Rule, ...] = BASE + MORE, rule_version: str = "1", ledger: DataFrame | None = None, doc_id: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(paths, ledger): every row of docs as (doc_id, blob, spans), and the ledger with the newly scanned blobs added.

    Null texts are the empty blob. Repeated rows stay repeated; an empty table gives empty results; a text of any length is
    scanned whole. spans is sorted by start, then by the order of the rules.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    paths = docs.select(F.col(doc_id), F.sha2(body.cast("binary"), 256).alias("blob"), body.alias("_text"))
    # One carrier per blob: equal texts meet in the map-side aggregate first, so a large group of copies is a row per task.
    # Texts without any match need no carrier at all and are left out of the shuffle; the ledger still gets their blobs.
    hit = F.lit(False)
    for r in rules:
        hit = hit | F.rlike(F.col("_text"), F.lit(r.pattern))
    new = paths.select("blob", F.when(hit, F.col("_text")).alias("_text")).groupBy("blob").agg(F.max("_text").alias("_text"))
    if ledger is not None:
        ledger = ledger.select("blob", "rule_version", F.col("spans").cast(SPAN).alias("spans"))
        new = new.join(ledger.where(F.col("rule_version") == rule_version).select("blob"), "blob", "left_anti")
    every = F.concat(*[spans(F.col("_text"), r, k) for k, r in enumerate(rules)])
    found = F.when(F.col("_text").isNull(), F.array().cast(SPAN)).otherwise(F.array_sort(every))
    scanned = new.select("blob", F.lit(rule_version).alias("rule_version"), found.alias("spans"))
    full = scanned if ledger is None else ledger.unionByName(scanned)
    full = cut(full)
    current = full.where((F.col("rule_version") == rule_version) & (F.size("spans") > 0)).select("blob", "spans")
    paths = paths.drop("_text").join(current, "blob", "left")
    return paths.select(doc_id, "blob", F.coalesce("spans", F.array().cast(SPAN)).alias("spans")), full


def redacted(docs: DataFrame, mark: str = "[SECRET]", doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with the spans that scan() finds in each text replaced by a mark; n_chars follows the text, other columns stay.

    Overlapping spans become one mark. Texts without a span, null ones among them, stay as they are.
    """
    paths, _ = scan(docs.select(doc_id, text).where(F.col(text).isNotNull()), doc_id=doc_id, text=text)
    blob, spans_ = unused(docs, "_blob"), unused(docs, "_spans")
    found = paths.where(F.size("spans") > 0).select("blob", "spans").groupBy("blob").agg(F.first("spans").alias(spans_))
    out = docs.withColumn(blob, F.sha2(F.col(text).cast("binary"), 256)).join(found.withColumnRenamed("blob", blob), blob, "left")

    def step(acc: Column, s: Column) -> Column:
        gap = F.when(s["start"] >= acc["at"], F.concat(F.substring(F.col(text), acc["at"].cast("int") + 1, (s["start"] - acc["at"]).cast("int")), F.lit(mark))).otherwise(F.lit(""))
        return F.struct(F.concat(acc["out"], gap).alias("out"), F.greatest(acc["at"], s["stop"]).alias("at"))

    first = F.struct(F.lit("").alias("out"), F.lit(0).cast("bigint").alias("at"))
    clean = F.aggregate(spans_, first, step, lambda acc: F.concat(acc["out"], F.substring(F.col(text), acc["at"].cast("int") + 1, F.length(text))))
    out = out.withColumn(text, F.when(F.col(spans_).isNull(), F.col(text)).otherwise(clean)).drop(blob, spans_)
    return out.withColumn("n_chars", F.length(text).cast("long")) if "n_chars" in docs.columns else out


def history(docs: DataFrame, commits: list[DataFrame], rules: tuple[Rule, ...] = BASE + MORE, rule_version: str = "1", doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, blob, spans) of docs, scanned against the ledger that the commits before them left, in their order."""
    ledger = None
    for rows in commits:
        _, ledger = scan(rows, rules, rule_version, ledger, doc_id, text)
    return scan(docs, rules, rule_version, ledger, doc_id, text)[0]


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, after an earlier commit that held those whose text has an even CRC. What that commit brought into the ledger
    is looked up, every other text is scanned, and the findings of both go to all rows."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    earlier = docs.where(F.crc32(F.coalesce("text", F.lit("")).cast("binary")) % 2 == 0)
    paths = history(docs, [earlier])
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    base = F.filter("spans", lambda s: s["kind"].isin([r.kind for r in BASE]))
    return paths.select(
        "doc_id", count("assign").alias("n_assign"), count("access").alias("n_access"), count("hex").alias("n_hex"),
        F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"),
    )


def _sql() -> str:
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    found = []
    for order, r in enumerate(BASE + MORE):
        p = quoted(r.pattern)
        runs, values, gaps = f"regexp_extract_all(t, {p})", f"regexp_extract_all(t, {p}, {r.group})", f"string_split_regex(t, {p})"
        before = lambda n: f"list_sum(list_transform(list_slice({gaps}, 1, i + 1), lambda g: length(g))) + coalesce(list_sum(list_transform(list_slice({runs}, 1, {n}), lambda g: length(g))), 0)"  # noqa: B023, E731
        one = f"{{'start': CAST({before('i')} AS BIGINT), 'ord': {order}, 'kind': '{r.kind}', 'stop': CAST({before('i + 1')} AS BIGINT)}}"
        found.append(f"list_transform(list_filter(range(len({runs})), lambda i: length({values}[i + 1]) >= {r.least}), lambda i: {one})")
    count = lambda k: f"len(list_filter(s, lambda x: x.kind = '{k}'))"
    text = lambda s: f"array_to_string(list_transform({s}, lambda x: x.kind || ':' || x.start || ':' || x.stop), ',')"
    base = "list_filter(s, lambda x: x.kind IN (" + ", ".join(f"'{r.kind}'" for r in BASE) + "))"
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
f AS (SELECT doc_id, list_sort(list_concat({", ".join(found)})) AS s FROM d)
SELECT doc_id, {", ".join(f"{count(r.kind)} AS n_{r.kind}" for r in BASE)}, sha256({text(base)}) AS base_sha256, {text("s")} AS spans FROM f
"""


SQL = _sql()
