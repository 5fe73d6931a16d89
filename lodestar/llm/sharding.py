"""Sharding by a weighted hash tree over regions, racks and shards. Native: DataFrame expressions only.

Law `key`: the row's key and the tree decide, nothing else. On every level each child of the node that was reached draws an
exponential waiting time -ln(u) / weight, with u from a hash of the key and the child's path, and the row goes to the child with the
least draw: first a region, then a rack in it, then a shard. A child's weight is the sum of the shards below it.

So a changed weight alters only draws on the paths from the root to the shards that changed. Where a node's children all keep their
weights, no row moves between them; where one grows, rows move only into its subtree; where one shrinks, only out of it. A shift
inside a rack moves rows only inside that rack. A shard that comes as a region of its own takes rows only into itself; one that
comes into an old rack makes that rack and region heavier, and rows that these draw from others may go to any shard in them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, table

Tree = dict[str, dict[str, dict[int, float]]]


def even_tree(shards: int, per_rack: int = 2, racks: int = 2) -> Tree:
    """Shards of equal weight, two to a rack and two racks to a region."""
    tree: Tree = {}
    for s in range(shards):
        rack = s // per_rack
        tree.setdefault(f"region{rack // racks}", {}).setdefault(f"rack{rack}", {})[s] = 1.0
    return tree


def _levels(tree: Tree) -> list[dict[str, dict[str, float]]]:
    """Per level: path of a node -> weights of its children by path. What has no weight above 0 is left out."""
    top, middle, low = {"": {}}, {}, {}
    for region, racks in tree.items():
        for rack, shards in racks.items():
            leaves = {f"{region}/{rack}/{s}": float(w) for s, w in shards.items() if w > 0}
            if leaves:
                low[f"{region}/{rack}"] = leaves
                middle.setdefault(region, {})[f"{region}/{rack}"] = sum(leaves.values())
        if region in middle:
            top[""][region] = sum(middle[region].values())
    if not top[""]:
        raise ValueError("the tree has no shard of positive weight")
    return [top, middle, low]


def place(key: Column, tree: Tree) -> Column:
    """The shard of a key. Null is a key like any other. Shards of weight 0 or less take no rows."""
    text = F.coalesce(F.concat(F.lit("k"), key.cast("string")), F.lit("n"))

    def least(children: Column) -> Column:
        def draw(c: Column) -> Column:
            u = (F.conv(F.substring(F.md5(F.concat(text, F.lit("/"), c["path"]).cast("binary")), 1, 13), 16, 10).cast("double") + 0.5) / F.lit(2.0**52)
            return F.struct((-F.log(u) / c["weight"]).alias("draw"), c["path"].alias("path"))

        return F.array_min(F.transform(children, draw))["path"]

    at = F.lit("")
    for level in _levels(tree):
        nodes = [(F.lit(p), F.array(*[F.struct(F.lit(c).alias("path"), F.lit(w).alias("weight")) for c, w in kids.items()])) for p, kids in level.items()]
        at = least(nodes[0][1] if len(nodes) == 1 else F.create_map(*[x for n in nodes for x in n])[at])
    return F.substring_index(at, "/", -1).cast("int")


def shard(docs: DataFrame, tree: Tree, grown: Tree | None = None, key: str = "doc_id", text: str = "text", slot_buckets: int = 4096) -> DataFrame:
    """Place every row and number the rows of each shard from 0 without gaps.

    Returns key, size (UTF-8 bytes plus 1; null texts count as empty), text_crc32, shard, slot and grown_shard (placement
    under the tree `grown`, null without one). Null keys are placed by the hash of null; repeated rows share a shard and get
    slots of their own; an empty table gives an empty result; other columns are ignored.

    Equal rows are counted first, so a key or text that very many rows share is one row from then on. Slots come from prefix sums:
    hash buckets inside each shard are numbered by themselves and start where the buckets before them end, so no task orders a
    whole shard. The bucket counts are shards x slot_buckets rows at most, hence the broadcast.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(key).alias("k"), (F.octet_length(body) + 1).cast("long").alias("size"), F.crc32(body.cast("binary")).alias("text_crc32"))
    rows = rows.groupBy("k", "size", "text_crc32").agg(F.count("*").alias("n"))
    digest = F.md5(F.concat_ws(":", F.coalesce(F.col("k").cast("string"), F.lit("n")), "text_crc32", F.lit("slot")).cast("binary"))
    rows = rows.withColumn("shard", place(F.col("k"), tree)).withColumn("grown_shard", place(F.col("k"), grown) if grown else F.lit(None).cast("int"))
    rows = cut(rows.withColumn("b", (F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") % slot_buckets).cast("int")))
    before = Window.partitionBy("shard").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy("shard", "b").agg(F.sum("n").alias("n")).select("shard", "b", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    inside = Window.partitionBy("shard", "b").orderBy("k", "text_crc32", "size").rowsBetween(Window.unboundedPreceding, -1)
    out = rows.withColumn("i", F.coalesce(F.sum("n").over(inside), F.lit(0))).join(F.broadcast(starts), ["shard", "b"])
    # Equal rows again one by one, a thousand at a time, so that no array grows with a group.
    chunk = F.lit(1000).cast("long")
    out = out.withColumn("c", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, chunk)))
    slot = F.explode(F.sequence(F.col("start") + F.col("i") + F.col("c"), F.col("start") + F.col("i") + F.least(F.col("c") + chunk, F.col("n")) - 1)).alias("slot")
    return out.select(F.col("k").alias(key), "size", "text_crc32", F.lit("key").alias("law"), "shard", slot, "grown_shard")


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(table(spark, sf_dir, "documents"), even_tree(16), even_tree(17))


def _sql() -> str:
    draw = "-ln((CAST('0x' || substr(md5({0} || '/' || {1}), 1, 13) AS BIGINT)::DOUBLE + 0.5) / 4503599627370496.0::DOUBLE) / {2}"

    def pick(children: str, path: str, weight: str) -> str:
        return f"list_sort(list_transform({children}, lambda c: {{'draw': {draw.format('kt', path, weight)}, 'path': {path}}}))[1].path"

    # Two shards to a rack, two racks to a region; shard 16 is alone in rack 8 of region 4.
    alone = "CASE WHEN {0} THEN ['region4/rack8'] ELSE list_transform(range(2), lambda i: {1} || '/rack' || (2 * CAST(substr({1}, 7) AS INT) + i)) END"
    steps, cols = [], {"shard": "range(4)", "grown_shard": "range(5)"}
    steps.append("r AS (SELECT *, " + ", ".join(f"{pick(v, chr(39) + 'region' + chr(39) + ' || c', 'CASE WHEN c = 4 THEN 1.0::DOUBLE ELSE 4.0::DOUBLE END')} AS {k}_r" for k, v in cols.items()) + " FROM d)")
    steps.append("k AS (SELECT *, " + ", ".join(f"{pick(alone.format(f'{k}_r = ' + chr(39) + 'region4' + chr(39), f'{k}_r'), 'c', '2.0::DOUBLE')} AS {k}_k" for k in cols) + " FROM r)")
    leaf = "CASE WHEN {0} = 'region4/rack8' THEN ['region4/rack8/16'] ELSE list_transform(range(2), lambda i: {0} || '/' || (2 * CAST(split_part({0}, '/rack', 2) AS INT) + i)) END"
    steps.append("s AS (SELECT *, " + ", ".join(f"CAST(split_part({pick(leaf.format(f'{k}_k'), 'c', '1.0::DOUBLE')}, '/', 3) AS INT) AS {k}" for k in cols) + " FROM k)")
    # CRC-32 by half bytes: its table of sixteen from the polynomial, then one step per hex digit, the low one of a byte first.
    half = []
    for x in range(16):
        for _ in range(4):
            x = x >> 1 ^ (0xEDB88320 if x & 1 else 0)
        half.append(x)
    return f"""
WITH h AS (SELECT doc_id, CAST(octet_length(encode(coalesce(text, ''))) + 1 AS BIGINT) AS size, coalesce('k' || doc_id, 'n') AS kt, string_split(hex(encode(coalesce(text, ''))), '') AS digits FROM documents),
d AS (SELECT doc_id, size, kt, xor(list_reduce(list_transform(range(2 * size - 2), lambda j: CAST('0x' || digits[xor(j, 1) + 1] AS BIGINT)), lambda a, x: xor(a // 16, {half}[xor(a % 16, x) + 1]), 4294967295), 4294967295) AS text_crc32 FROM h),
{", ".join(steps)},
b AS (SELECT *, CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), 'n') || ':' || text_crc32 || ':slot'), 1, 8) AS BIGINT) % 4096 AS b FROM s)
SELECT doc_id, size, text_crc32, 'key' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY b, doc_id NULLS FIRST, text_crc32, size) - 1 AS slot, grown_shard FROM b
"""


SQL = _sql()
