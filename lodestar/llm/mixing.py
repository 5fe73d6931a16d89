"""Mixing sources to target weights by systematic sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, n_words, ranked, table


def targets(sizes: DataFrame, source: str, weights: tuple[int, ...], share: float, most: float) -> DataFrame:
    """Target words of each source: share of all words dealt by weight, none above most times the source's size.

    sizes has one row per source with source_size. The excess of capped sources goes to the others by weight until none is
    above its cap. Only sums over all sources reach the driver; each round is one small aggregate, and the level only rises.
    """
    w = F.element_at(F.array(*[F.lit(x) for x in weights]), (F.col("_r") % len(weights) + 1).cast("int"))
    src = cut(ranked(sizes, source, "_r").withColumn("w", w).drop("_r"))
    total = src.agg(F.sum("source_size")).first()[0] or 0
    level, cap = -1.0, F.lit(float(most)) * F.col("source_size")
    while True:
        capped = cap <= F.lit(level) * F.col("w")
        held, open_w = src.agg(F.coalesce(F.sum(F.when(capped, cap)), F.lit(0.0)), F.coalesce(F.sum(F.when(~capped, F.col("w"))), F.lit(0))).first()
        new = (share * total - held) / open_w if open_w else level
        if new <= level or not open_w:
            break
        level = new
    return src.select(source, "source_size", F.least(cap, F.lit(level) * F.col("w")).alias("target"))


def mix(docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0, seed: int = 7, sub_buckets: int = 64, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """Copies of each document in the mix.

    Within a source each document expects target / source_size copies. The expected copies are summed along the source, the
    source's random offset (a hash of seed and source) is added, and a document is emitted once per integer that its step
    crosses: at most ceil(most) times. Documents are ordered by size class (the root of the size), so that the words taken
    stay near the target; hash sub-buckets inside a class let every (source, class, sub-bucket) be summed on its own.

    Returns the document's columns plus size, source_size, target, copies and taken. A null text has size 0; null sources
    are one source, last; an empty table gives an empty result; repeated rows are separate documents. Rows of one id and size are
    ordered by the CRC of their texts, so that reruns agree. Columns of docs named like the new ones are dropped in favour of them;
    names that begin with _mix_ are taken.
    """
    new = ["size", "source_size", "target", "copies", "taken"]
    rows = docs.select(*[c for c in docs.columns if c not in new], n_words(F.col(text)).alias("size"))
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(doc_id).cast("string")).cast("binary"))
    rows = rows.withColumn("_mix_c", F.floor(F.sqrt("size")).cast("int")).withColumn("_mix_b", (F.conv(F.substring(digest, 1, 6), 16, 10).cast("long") % sub_buckets).cast("int"))
    cells = cut(rows.groupBy(F.col(source), "_mix_c", "_mix_b").agg(F.count("*").alias("_mix_n"), F.sum("size").alias("_mix_s")))
    goal = targets(cells.groupBy(source).agg(F.sum("_mix_s").alias("source_size")), source, weights, share, most)
    before = Window.partitionBy(source).orderBy("_mix_c", "_mix_b").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.select(F.col(source).alias("_mix_src"), F.col("_mix_c").alias("_mix_cc"), F.col("_mix_b").alias("_mix_bb"), F.coalesce(F.sum("_mix_n").over(before), F.lit(0)).alias("_mix_start"))
    cells = cells.join(goal.withColumnRenamed(source, "_mix_gs"), F.col("_mix_src").eqNullSafe(F.col("_mix_gs"))).drop("_mix_gs")
    inside = Window.partitionBy(source, "_mix_c", "_mix_b").orderBy(doc_id, "size", F.crc32(F.coalesce(F.col(text), F.lit("")).cast("binary")))
    rows = rows.withColumn("_mix_i", F.row_number().over(inside))
    rows = rows.join(cells, F.col(source).eqNullSafe(F.col("_mix_src")) & (F.col("_mix_c") == F.col("_mix_cc")) & (F.col("_mix_b") == F.col("_mix_bb")))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    u = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.concat(F.lit("s"), source), F.lit("n"))).cast("binary")), 1, 8), 16, 10).cast("double") / 2.0**32

    def crossed(i: Column) -> Column:
        return F.floor(u + i * rate)

    i = (F.col("_mix_start") + F.col("_mix_i")).cast("double")
    rows = rows.withColumn("copies", (crossed(i) - crossed(i - 1)).cast("long")).withColumn("taken", F.col("copies") * F.col("size"))
    return rows.drop("_mix_c", "_mix_b", "_mix_i", "_mix_src", "_mix_cc", "_mix_bb", "_mix_start")


def emit(mixed: DataFrame, columns: list[str]) -> DataFrame:
    """The mix itself: every document as often as it was drawn."""
    return mixed.where("copies > 0").withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select(*columns)


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mix(docs.select("doc_id", "source", "text")).select("doc_id", "size", "source_size", "target", "taken", "copies")


SQL = r"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
  CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS w FROM d GROUP BY source),
r AS (SELECT *, sum(2.0::DOUBLE * source_size) OVER o AS held, sum(w) OVER () - sum(w) OVER o AS open_w,
  lead(2.0::DOUBLE * source_size / w) OVER o AS next_ratio, (SELECT sum(source_size) FROM s) AS total
  FROM s WINDOW o AS (ORDER BY 2.0::DOUBLE * source_size / w, source NULLS LAST ROWS UNBOUNDED PRECEDING)),
lv AS (SELECT level FROM (
  SELECT held, (1.5::DOUBLE * total - held) / open_w AS level, next_ratio FROM r WHERE open_w > 0
  UNION ALL SELECT -1, 1.5::DOUBLE * sum(source_size) / sum(w), min(2.0::DOUBLE * source_size / w) FROM s)
  WHERE level < next_ratio ORDER BY held LIMIT 1),
t AS (SELECT source, source_size, least(2.0::DOUBLE * source_size, (SELECT level FROM lv) * w) AS target FROM s),
k AS (SELECT d.*, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0.0::DOUBLE END AS rate,
  CAST('0x' || substr(md5('7:' || coalesce('s' || d.source, 'n')), 1, 8) AS BIGINT)::DOUBLE / 4294967296.0::DOUBLE AS u,
  CAST(row_number() OVER (PARTITION BY d.source ORDER BY CAST(floor(sqrt(d.size)) AS INT),
    CAST('0x' || substr(md5('7:' || doc_id), 1, 6) AS BIGINT) % 64, doc_id) AS DOUBLE) AS i
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, CAST((floor(u + i * rate) - floor(u + (i - 1) * rate)) * size AS BIGINT) AS taken,
  CAST(floor(u + i * rate) - floor(u + (i - 1) * rate) AS BIGINT) AS copies FROM k
"""
