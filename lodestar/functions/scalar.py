"""Column functions: number parsing, annual wages, codes, names, slugs, trigrams, vectors, documents."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# --- numbers and wages -------------------------------------------------------------------------------------------------


def first_number(s: Column) -> Column:
    """The first number once thousands separators are gone; null if there is none."""
    return F.regexp_extract(F.replace(s, F.lit(","), F.lit("")), r"[0-9]+([.][0-9]+)?", 0).try_cast("double")


def strip_number(s: Column) -> Column:
    """All characters but digits and dots deleted, then read as a number; null if it is none."""
    return F.regexp_replace(s, r"[^0-9.]", "").try_cast("double")


#: Pay periods in a year.
PERIODS = {"YEAR": 1, "HOUR": 2080, "WEEK": 52, "MONTH": 12, "BI-WEEKLY": 26}


def annualize(amount: Column, unit: Column) -> Column:
    """Amount per year. A null unit is a year; an unknown one gives null. Case doesn't matter, blanks do."""
    u = F.upper(F.coalesce(unit, F.lit("Year")))
    per = F.lit(None).cast("int")
    for name, n in PERIODS.items():
        per = F.when(u == name, n).otherwise(per)
    return amount * per


def in_gate(wage: Column, low: int = 20_000, high: int = 1_000_000) -> Column:
    return wage.between(low, high)


# --- codes, ids, names -------------------------------------------------------------------------------------------------


def clean_code(s: Column) -> Column:
    """NN-NNNN without a trailing .NN; null for anything else."""
    code = F.regexp_replace(F.trim(s), r"[.][0-9]+$", "")
    return F.when(code.rlike(r"^[0-9]{2}-[0-9]{4}") & (F.length(code) == 7), code)


def norm_title(s: Column, low: int = 2, high: int = 500) -> Column:
    t = F.lower(F.trim(s))
    return F.when(F.length(t).between(low, high), t)


def valid_fein(s: Column, strict: bool = True) -> Column:
    return F.coalesce(s.rlike(r"^[0-9]{2}-[0-9]{7}$" if strict else r"^[0-9]{2}-?[0-9]{6,}$"), F.lit(False))


def naics2(s: Column) -> Column:
    return F.when(F.length(s) >= 2, F.substring(s, 1, 2))


def valid_state(s: Column) -> Column:
    return F.length(s) == 2


def bucketize(conf: Column) -> Column:
    """Labelled confidence bands; null and values over 1 are (missing)."""
    out = F.lit("(missing)")
    for low, high, name in ((0.9, 1.0000001, "0.90-1.00"), (0.8, 0.9, "0.80-0.90"), (0.7, 0.8, "0.70-0.80"), (0.6, 0.7, "0.60-0.70"), (0.5, 0.6, "0.50-0.60"), (-1e300, 0.5, "<0.50")):
        out = F.when((conf >= low) & (conf < high), name).otherwise(out)
    return out


def _folded() -> tuple[str, str]:
    """Lower-case letters and digits whose compatibility form, marks left out, is one ASCII letter or digit; and those."""
    plain = {chr(c): "".join(x for x in unicodedata.normalize("NFKD", chr(c)).lower() if not unicodedata.combining(x)) for c in range(128, 0x10000)}
    one = {c: p for c, p in plain.items() if len(p) == 1 and p.isascii() and p.isalnum()}
    return "".join(one), "".join(one.values())


_FOLD = _folded()


def slugify(s: Column, size: int = 80) -> Column:
    """Lower case without diacritics, & as and, runs of anything else as one dash.

    Spark has no NFKD: composed letters go through a table, loose marks are deleted; a character that stands for several letters
    (a ligature) counts as anything else.
    """
    plain = F.translate(F.regexp_replace(F.lower(s), r"\p{M}+", ""), *_FOLD)
    dashed = F.regexp_replace(F.replace(plain, F.lit("&"), F.lit(" and ")), r"[^a-z0-9]+", "-")
    return F.regexp_replace(F.substring(F.regexp_replace(dashed, r"^-+|-+$", ""), 1, size), r"-+$", "")


def code_slug(title: Column, code: Column) -> Column:
    return F.concat_ws("-", slugify(title), code)


def state_slug(name: Column, code: Column) -> Column:
    return F.concat_ws("-", slugify(name), F.lower(code))


def sector_slug(label: Column, code: Column) -> Column:
    return F.concat_ws("-", slugify(label), code)


def trailing_code(slug: Column) -> Column:
    """The code at the end of a slug; null if there is none."""
    return F.nullif(F.regexp_extract(slug, r"([0-9]{2}-[0-9]{4})$", 1), F.lit(""))


def like_escape(q: Column) -> Column:
    return F.regexp_replace(q, r"([%_\\])", r"\\$1")


def quarter_label(ts: Column) -> Column:
    return F.concat(F.year(ts).cast("string"), F.lit("-q"), F.quarter(ts).cast("string"))


def label_display(label: Column) -> Column:
    """2020-q3 as Q3 2020; anything else as it is."""
    return F.when(label.rlike("^[0-9]{4}-q[1-4]$"), F.concat(F.lit("Q"), F.right(label, F.lit(1)), F.lit(" "), F.left(label, F.lit(4)))).otherwise(label)


def short_code(name: Column) -> Column:
    return F.upper(F.substring(F.regexp_replace(F.split(F.trim(name), r"\s+")[0], r"[^A-Za-z0-9]", ""), 1, 12))


def short_codes(df: DataFrame, name: str, *order: str, out: str = "code") -> DataFrame:
    """short_code of each row; the second and later rows of one code, by the order, get ·2, ·3 and so on."""
    k = F.row_number().over(Window.partitionBy("_code").orderBy(*order))
    coded = df.withColumn("_code", short_code(F.col(name))).withColumn("_k", k)
    return coded.withColumn(out, F.when(F.col("_k") > 1, F.concat("_code", F.lit("·"), F.col("_k").cast("string"))).otherwise(F.col("_code"))).drop("_code", "_k")


def disambiguate(df: DataFrame, name: str, state: str, fein: str, key: str, out: str = "display") -> DataFrame:
    """Equal names get (state) if every state in the group is there and unique, else (FEIN …last4), else (#id6)."""
    w = Window.partitionBy(name)
    n = F.count("*").over(w)
    by_state = (F.count(state).over(w) == n) & (F.size(F.collect_set(state).over(w)) == n)
    tag = F.when(by_state, F.concat(F.lit(" ("), F.col(state), F.lit(")")))
    tag = tag.when(F.col(fein).isNotNull(), F.concat(F.lit(" (FEIN …"), F.right(fein, F.lit(4)), F.lit(")"))).otherwise(F.concat(F.lit(" (#"), F.substring(key, 1, 6), F.lit(")")))
    return df.withColumn(out, F.when(n > 1, F.concat(F.col(name), tag)).otherwise(F.col(name)))


def dedup_slugs(df: DataFrame, slug: str, rank: str, out: str = "slug_unique") -> DataFrame:
    k = F.row_number().over(Window.partitionBy(slug).orderBy(rank))
    return df.withColumn(out, F.when(k > 1, F.concat_ws("-", slug, k.cast("string"))).otherwise(F.col(slug)))


# --- trigrams and vectors ----------------------------------------------------------------------------------------------


def trigrams(s: Column) -> Column:
    """Distinct padded 3-grams of the lower-cased words of a name, in order of their first occurrence."""
    words = F.array_distinct(F.filter(F.split(F.lower(s), r"[^\p{L}\p{N}]+"), lambda w: w != ""))
    # Words, each with two blanks before and one behind, a blank apart: no run of three that mixes two words has one of these forms.
    padded = F.concat(F.lit("  "), F.array_join(words, "   "), F.lit(" "))
    return F.array_distinct(F.regexp_extract_all(padded, F.lit(r"(?=(  \S| \S\S| \S |\S\S\S|\S\S ))"), F.lit(1)))


def jaccard(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b)) / F.nullif(F.size(F.array_union(a, b)), F.lit(0))


def trigram_similarity(a: Column, b: Column) -> Column:
    return jaccard(trigrams(a), trigrams(b))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def l2_normalize(v: Column) -> Column:
    return F.transform(v, lambda x: x / F.sqrt(dot(v, v)))


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


# --- documents ---------------------------------------------------------------------------------------------------------


def json_text(doc: Column, key: str) -> Column:
    return F.get_json_object(doc, f"$.{key}")


def has_key(doc: Column, key: str) -> Column:
    """A key with a JSON null is there; a missing key is not."""
    return F.coalesce(F.array_contains(F.json_object_keys(doc), key), F.lit(False))


def json_merge(doc: Column, patch: Column) -> Column:
    """Maps merged one level deep, the patch's values win, nulls among them."""
    return F.map_concat(F.map_filter(doc, lambda k, _: ~F.array_contains(F.map_keys(patch), k)), patch)


def per_100(part: Column, whole: Column, digits: int = 2) -> Column:
    """Percentage of two counts, rounded half up in integers; null if whole is 0."""
    scale = 10**digits
    return F.floor((200 * scale * part + whole) / F.nullif(2 * whole, F.lit(0))) / F.lit(float(scale))


def label_of(df: DataFrame, key: str, dim: DataFrame, code: str, label: str, out: str, fallback: str = "Other") -> DataFrame:
    """The label of key in a table of codes; fallback where the table has none."""
    d = dim.groupBy(F.col(code).alias("_code")).agg(F.min(label).alias(out))
    return df.join(d, F.col(key) == F.col("_code"), "left").withColumn(out, F.coalesce(out, F.lit(fallback))).drop("_code")


def per_capita(df: DataFrame, key: str, metric: str, dim: DataFrame, code: str, size: str, out: str) -> DataFrame:
    """metric per hundred of the size that a table gives for key; null where it gives none or not more than 0."""
    d = dim.groupBy(F.col(code).alias("_code")).agg(F.max(size).alias("_size"))
    return df.join(d, F.col(key) == F.col("_code"), "left").withColumn(out, F.when(F.col("_size") > 0, per_100(F.col(metric), F.col("_size")))).drop("_code", "_size")
