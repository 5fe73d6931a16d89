"""Record linkage: set-similarity join, nearest-neighbour join, and the entity resolution cascade."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from lodestar.functions.scalar import dot, jaccard, trigrams, valid_fein
from lodestar.sources.scratch import cut, tidy

from .nearest import nearest_vectors
from .tiles import encoded, similar_counts
from .upsert import latest, upsert

#: Adds a column v of vectors for a text column: any function of frames with the signature of embed.
Encoder = Callable[[DataFrame, str], DataFrame]


#: 64-bit words of a set's bitmap.
BITMAP = 8


def _least_overlap(theta: float, sizes: np.ndarray) -> np.ndarray:
    """The least overlap of two sets with similarity theta, by the sum of their sizes."""
    return np.ceil(theta / (1 + theta) * sizes - 1e-9)


def _prefix_rows(theta: float, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each set (r, side, block, grams by rarity, as hashes) a row for each gram of its prefix: place, size and bitmap."""
    for whole in batches:
        for start in range(0, whole.num_rows, 1024):
            batch = whole.slice(start, 1024)
            flat, n = batch.column(3).flatten().to_numpy(), np.diff(batch.column(3).offsets.to_numpy())
            row = np.repeat(np.arange(len(n)), n)
            bit = (flat.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - 9)).astype(np.int64)
            odd = (np.bincount(row * 64 * BITMAP + bit, minlength=len(n) * 64 * BITMAP) & 1).astype(np.uint8)
            bits = np.packbits(odd.reshape(-1, 64 * BITMAP), axis=1)
            place = np.arange(len(flat)) - np.repeat(np.cumsum(n) - n, n)
            first = place <= (n - np.ceil(theta * n - 1e-9))[row]
            at = pa.array(row[first])
            columns = [batch.column(0), batch.column(1), batch.column(2), pa.array(n, pa.int32()), pa.array([x.tobytes() for x in bits], pa.binary())]
            yield pa.RecordBatch.from_arrays([pa.array(flat[first]), pa.array(place[first], pa.int32()), *(c.take(at) for c in columns)], ["g", "place", "r", "side", "block", "size", "bits"])


def _met(theta: float, across: bool, group: pa.Table) -> pa.Table:
    """Pairs of a posting, or of two of its chunks, that size, places and bitmaps leave."""
    g, lo, hi, c, place, r, side, size = (group.column(k).to_numpy() for k in ("g", "lo", "hi", "c", "place", "r", "side", "size"))
    block, free = group.column("block").fill_null(0).to_numpy(), group.column("block").is_null().to_numpy()
    bits = np.frombuffer(b"".join(group.column("bits").to_pylist()), np.uint64).reshape(-1, BITMAP)
    none = np.zeros((0, 2), np.int64)

    def near(left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Pairs of side 0 and side 1, both in order of size."""
        out = [none]
        for k in range(0, len(left), 256):
            x = left[k : k + 256]
            first, end = np.searchsorted(size[right], [theta * size[x[0]] - 1e-9, size[x[-1]] / theta + 1e-9])
            y = right[first:end]
            if not len(y):
                continue
            both = size[x][:, None] + size[y]
            need = _least_overlap(theta, both)
            ok = np.minimum((size[x] - place[x])[:, None], size[y] - place[y]) >= need
            # A left row without a block may meet all, a right one only such.
            ok &= free[x][:, None] | (block[x][:, None] == block[y]) & ~free[y]
            if lo[x[0]] != hi[x[0]]:
                ok &= c[x][:, None] != c[y]
            i, j = np.nonzero(ok)
            good = np.bitwise_count(bits[x[i]] ^ bits[y[j]]).sum(axis=1) <= both[i, j] - 2 * need[i, j]
            out.append(np.column_stack([r[x[i[good]]], r[y[j[good]]]]))
        return np.concatenate(out)

    def sides(at: np.ndarray) -> Iterator[np.ndarray]:
        """Only rows of unlike sides are compared, and where there are many, only those of one block."""
        left, right = at[side[at] == 0], at[side[at] == 1]
        if len(left) * len(right) <= 1 << 16:
            yield near(left, right)
            return
        yield near(left[free[left]], right)
        left, right = left[~free[left]], right[~free[right]]
        for b in np.intersect1d(block[left], block[right]):
            yield near(left[block[left] == b], right[block[right] == b])

    order = np.lexsort((size, hi, lo, g))
    edges = np.flatnonzero(np.diff(g[order], prepend=g[order[:1]] - 1) | np.diff(lo[order], prepend=-1) | np.diff(hi[order], prepend=-1)).tolist() if len(order) else []
    found: list[np.ndarray] = []
    for start, stop in zip(edges, [*edges[1:], len(order)], strict=True):
        at = order[start:stop]
        if across:
            found += sides(at)
            continue
        if len(at) < 2:
            continue
        sizes, places, two = size[at], place[at], lo[at[0]] != hi[at[0]]
        for k in range(0, len(at), 256):  # sizes rise, so partners of these rows are among the rows up to the largest size allowed
            x = at[k : k + 256]
            end = int(np.searchsorted(sizes, sizes[min(k + 255, len(at) - 1)] / theta + 1e-9, "right"))
            y, sy = at[k:end], sizes[k:end]
            sx, both = size[x][:, None], size[x][:, None] + sy
            need = _least_overlap(theta, both)
            ok = (np.minimum(sx - place[x][:, None], sy - places[k:end]) >= need) & (np.arange(len(x))[:, None] < np.arange(len(y)))
            if two:
                ok &= c[x][:, None] != c[y]
            i, j = np.nonzero(ok)
            if len(i):
                apart = np.bitwise_count(bits[x[i]] ^ bits[y[j]]).sum(axis=1)
                good = apart <= both[i, j] - 2 * need[i, j]
                i, j = x[i[good]], y[j[good]]
                swap = r[i] > r[j]
                found.append(np.column_stack([np.where(swap, r[j], r[i]), np.where(swap, r[i], r[j])]))
    pairs = np.unique(np.concatenate([none, *found]), axis=0)
    return pa.table({"a": pa.array(pairs[:, 0], pa.int64()), "b": pa.array(pairs[:, 1], pa.int64())})


def similarity_candidates(sets: DataFrame, theta: float, across: bool, chunk: int = 4096) -> DataFrame:
    """Pairs (a, b) of sets (r, side, block, grams) that may reach similarity theta, among them all that do.

    Grams are ordered by how rare they are, and only the n - ceil(theta n) + 1 rarest of each set have postings. Two sets of a posting
    are compared by size, by the places of the gram (at the first gram that they share nothing before it can match, and what follows
    bounds the overlap), and by bitmaps of 512 parities, which differ in no more bits than the sets in grams. Only pairs that pass all
    of this leave a task. A posting of more than `chunk` sets is cut, and each two of its chunks are a group of their own; short ones
    share groups. With across, pairs are of side 0 and side 1, in one block; else of any two rows.
    """
    counts = sets.select(F.explode("grams").alias("g")).groupBy("g").agg(F.count("*").alias("n"))
    ordered = sets.select("r", F.explode("grams").alias("g")).join(counts, "g").groupBy("r").agg(F.array_sort(F.collect_list(F.struct("n", "g"))).alias("o"))
    rows = sets.select("r", "side", "block").join(ordered, "r").select("r", "side", "block", F.transform("o", lambda x: x["g"]).alias("grams"))
    postings = cut(rows.mapInArrow(lambda it: _prefix_rows(theta, it), "g long, place int, r long, side int, block long, size int, bits binary"))
    many = postings.groupBy("g").agg(F.count("*").alias("n"), F.min("side").alias("low"), F.max("side").alias("high")).where("low < high" if across else "n > 1")
    many = cut(many.select("g", F.ceil(F.col("n") / chunk).cast("int").alias("chunks"), "n"))
    packs = max(1, -(-(many.agg(F.sum("n")).first()[0] or 0) // (8 * chunk)))
    near = postings.join(many.select("g", "chunks"), "g").withColumn("c", F.pmod(F.xxhash64("r"), F.col("chunks")).cast("int")).withColumn("d", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    pack = F.when(F.col("chunks") == 1, F.pmod(F.xxhash64("g"), F.lit(packs))).otherwise(F.xxhash64("g", F.least("c", "d"), F.greatest("c", "d")))
    near = near.select(pack.alias("pack"), "g", F.least("c", "d").alias("lo"), F.greatest("c", "d").alias("hi"), "c", "place", "r", "side", "block", "size", "bits")
    return near.groupBy("pack").applyInArrow(lambda t: _met(theta, across, t), "a long, b long").distinct()


def _verified(pairs: DataFrame, left: DataFrame, right: DataFrame, theta: float) -> DataFrame:
    """(left_id, right_id, sim) of the candidates whose full sets reach theta."""
    side = lambda df, c, s: df.select(F.col("r").alias(c), F.col("id").alias(f"{s}_id"), F.col("grams").alias(f"{s}_g"))
    # The sets make the work, not the few bytes of a pair: without a number of partitions they would be put together again.
    pairs = cut(pairs)
    both = pairs.repartition(max(1, -(-pairs.count() // 5000)), "a", "b").join(side(left, "a", "left"), "a").join(side(right, "b", "right"), "b")
    shared = F.size(F.array_intersect("left_g", "right_g"))
    met = both.select("left_id", "right_id", (F.size("left_g") + F.size("right_g")).alias("total"), shared.alias("shared"))
    return met.select("left_id", "right_id", (F.col("shared") / (F.col("total") - F.col("shared"))).alias("sim")).where(F.col("sim") >= theta)


def _sets(df: DataFrame, side: int, block: Column) -> DataFrame:
    """r (a number of its own), id, side, block and grams, as 64-bit hashes, of each row that has some. A million different grams hold
    two of one hash with a probability of 3e-8."""
    grams = F.col("grams") if "grams" in df.columns else trigrams(F.col("name"))
    codes = F.transform(grams, lambda g: F.xxhash64(g))
    rows = df.select("id", F.lit(side).alias("side"), block.alias("block"), codes.alias("grams"))
    # A filter before the cut would make the grams twice.
    return cut(rows.withColumn("r", F.monotonically_increasing_id())).where(F.size("grams") > 0)


def set_similarity_join(left: DataFrame, right: DataFrame, theta: float, block: str | None = None) -> DataFrame:
    """(left_id, right_id, sim) of all names with trigram similarity of at least theta. Frames: id, name and the block column.

    A null block on the left means any; a null block on the right meets null only. Names without grams meet nothing; ids may repeat,
    and each row is joined for itself.
    """
    key = F.xxhash64(block) if block else F.lit(0).cast("long")
    key = F.when(F.col(block).isNotNull(), key) if block else key
    a, b = _sets(left, 0, key), _sets(right, 1, key)
    both = a.drop("id").withColumn("r", F.col("r") * 2).unionByName(b.drop("id").withColumn("r", F.col("r") * 2 + 1))
    met = similarity_candidates(both, theta, True).select(F.shiftright("a", 1).alias("a"), F.shiftright("b", 1).alias("b"))
    return _verified(met, a, b, theta)


def similar_pairs(rows: DataFrame, theta: float) -> DataFrame:
    """(left_id, right_id, sim) of each two rows (id, and name or grams) with trigram similarity of at least theta, once."""
    sets = _sets(rows, 0, F.lit(0).cast("long"))
    return _verified(similarity_candidates(sets, theta, False), sets, sets, theta)


def similarity_classes(rows: DataFrame, theta: float) -> DataFrame:
    """(id, class_id, links) per row of (id, name): its class of equal gram sets, and how many other rows reach theta.

    Equal sets are one class, named by a 128-bit digest of the set; only one row of each class is compared, and each pair of classes
    is met once, in a tile that returns sums. Rows without grams have no class and no links; ids may be null or repeat.
    """
    # Grams cost more than their texts' bytes suggest, so rows are spread first.
    spread = rows.select("id", "name").repartition(rows.sparkSession.sparkContext.defaultParallelism)
    named = spread.select("id", F.array_sort(trigrams(F.col("name"))).alias("grams"))
    kind = dict(rows.dtypes)["id"]
    named = named.select("id", F.when(F.size("grams") > 0, F.md5(F.to_json("grams"))).alias("class_id"), "grams")
    with tidy(rows.sparkSession):
        rows = cut(named.mapInArrow(encoded, f"id {kind}, class_id string, size long, data binary"))
        classes = cut(rows.where("class_id IS NOT NULL").groupBy("class_id").agg(F.first("size").alias("size"), F.first("data").alias("data"), F.count("*").alias("n")))
    beside = similar_counts(classes, theta)
    rows, classes = rows.select("id", "class_id"), classes.select("class_id", "n")
    links = classes.join(beside, "class_id", "left").select("class_id", (F.col("n") - 1 + F.coalesce("m", F.lit(0))).alias("links"))
    return rows.join(links, "class_id", "left").select("id", "class_id", F.coalesce("links", F.lit(0)).cast("long").alias("links"))


def best_match(pairs: DataFrame) -> DataFrame:
    w = Window.partitionBy("left_id").orderBy(F.desc("sim"), "right_id")
    return pairs.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")


def seed_entities(records: DataFrame, order: list[str]) -> DataFrame:
    """One entity per valid employer id: named by its first record, counted over all."""
    rows = records.where(valid_fein(F.col("employer_fein")))
    return rows.groupBy("employer_fein").agg(F.min_by("employer_name", F.struct(*order)).alias("canonical_name"), F.min_by("employer_state", F.struct(*order)).alias("employer_state"), F.count("*").alias("record_count")).select(
        F.sha2(F.col("employer_fein"), 256).alias("id"), F.col("employer_fein").alias("fein"), "canonical_name", "employer_state", "record_count"
    )


def resolve_by_id(records: DataFrame, entities: DataFrame) -> DataFrame:
    """record_id and entity id where a valid employer id is known."""
    e = entities.where("fein IS NOT NULL").select(F.col("fein").alias("employer_fein"), F.col("id").alias("entity_id"))
    return records.where(valid_fein(F.col("employer_fein"))).join(e, "employer_fein").select("record_id", "entity_id")


def resolve_by_vector(names: DataFrame, entities: DataFrame, max_distance: float = 0.15, encoder: Encoder | None = None) -> DataFrame:
    """(id, entity_id) of names (id, name) whose nearest entity by name is at most max_distance away by cosine. No blocking."""
    encode = encoder or embed
    q = encode(names.select("name").where("name IS NOT NULL").distinct(), "name").select(F.col("name").alias("id"), "v")
    # Of entities with one name, or with one vector, only the smallest id can be the answer.
    one = entities.where("canonical_name IS NOT NULL").groupBy("canonical_name").agg(F.min("id").alias("id"))
    e = encode(one.select("id", "canonical_name"), "canonical_name").groupBy("v").agg(F.min("id").alias("id"))
    near = nearest_vectors(q, cut(e), 1, floor=1 - max_distance).where(F.round(1 - F.col("sim"), 6) <= max_distance)
    return names.join(near.select(F.col("query_id").alias("name"), F.col("base_id").alias("entity_id")), "name").select("id", "entity_id")


def resolve_by_name(names: DataFrame, entities: DataFrame, theta: float = 0.85) -> DataFrame:
    """(id, entity_id) of names (id, name, state) that reach theta with an entity (id, name, state): the most similar one, of equals
    the smallest id. States meet as in set_similarity_join.

    Rows of one name and state have one answer, and of such entities only the smallest id can be it: each is compared once.
    """
    asked = names.where("name IS NOT NULL").select(F.struct("name", "state").alias("id"), "name", "state").distinct()
    known = entities.where("name IS NOT NULL").groupBy("name", "state").agg(F.min("id").alias("id"))
    best = best_match(set_similarity_join(asked, known, theta, "state"))
    best = best.select(F.col("left_id.name").alias("_n"), F.col("left_id.state").alias("_s"), F.col("right_id").alias("entity_id"))
    return names.join(best, (F.col("name") == F.col("_n")) & F.col("state").eqNullSafe(F.col("_s"))).select("id", "entity_id")


def resolve(names: DataFrame, entities: DataFrame, theta: float = 0.85, vector_layer: Callable[[DataFrame, DataFrame], DataFrame] | None = None) -> DataFrame:
    """(id, entity_id, layer) of names (id, name, fein, state): employer id, then trigrams, then vectors; the first match wins.

    vector_layer takes the names that are left and the entities, as resolve_by_vector does; without one that layer is left out.
    """
    e = entities.where("fein IS NOT NULL").select("fein", F.col("id").alias("entity_id"))
    one = names.where(valid_fein(F.col("fein"))).join(e, "fein").groupBy("id").agg(F.min("entity_id").alias("entity_id")).withColumn("layer", F.lit("id"))
    one = cut(one)  # it and what it leaves are read several times
    left = cut(names.join(one, "id", "left_anti"))
    right = entities.select("id", F.col("canonical_name").alias("name"), F.col("employer_state").alias("state"))
    two = resolve_by_name(left, right, theta).withColumn("layer", F.lit("trigram"))
    if vector_layer is not None:
        two = cut(two)
        left = cut(left.join(two, "id", "left_anti"))
    out = one.unionByName(two)
    if vector_layer is not None:
        out = out.unionByName(vector_layer(left, entities).select("id", "entity_id", F.lit("vector").alias("layer")))
    return out


def backfill_full(queue: DataFrame, entities: DataFrame, records: DataFrame, theta: float = 0.85, max_distance: float = 0.15, insert: bool = True, encoder: Encoder | None = None, limit: int = 0, weight: str | None = None) -> dict[str, DataFrame]:
    """The open rows of a queue (name, state, fein) resolved layer by layer, what no layer knows inserted, and the records written.

    Returns decisions (name, state, entity_id, layer), entities (with the inserted ones, and record_count raised by the records that
    an entity gained), records (with canonical_employer_id) and stats (layer, n). A blank name is not decided. With insert=False
    misses stay open. Nothing is written: a dry run only looks at stats. Inserted entities are named by a digest of name and state.
    With a limit only so many rows of the queue are taken, the first by name and state; 0 takes all. A row of records stands for as
    many of them as its column `weight` says, for one without. Records are read only by what is made of entities and of records.
    """
    rows = queue.where("trim(name) <> ''").groupBy(F.trim("name").alias("name"), "state").agg(F.min("fein").alias("fein"))
    rows = cut(rows.orderBy("name", "state").limit(limit)) if limit else rows
    named = cut(rows.withColumn("id", F.sha2(F.concat_ws("|", F.lower("name"), F.coalesce("state", F.lit(""))), 256)))
    hits = resolve(named, entities, theta, lambda n, e: resolve_by_vector(n, e, max_distance, encoder))
    decided = named.join(hits, "id", "left")
    if insert:
        decided = decided.withColumns({"layer": F.coalesce("layer", F.lit("inserted")), "entity_id": F.coalesce("entity_id", F.col("id").cast(dict(entities.dtypes)["id"]))})
    decided = cut(decided.where("entity_id IS NOT NULL"))
    new = decided.where("layer = 'inserted'").groupBy("entity_id").agg(F.min("name").alias("canonical_name"), F.min("state").alias("employer_state"), F.min("fein").alias("fein"))
    known = entities.select("id", "canonical_name", "employer_state", "fein", (F.col("record_count") if "record_count" in entities.columns else F.lit(0)).cast("long").alias("record_count"))
    every = known.unionByName(new.select(F.col("entity_id").alias("id"), "canonical_name", "employer_state", "fein", F.lit(0).cast("long").alias("record_count")))
    known_names = decided.select("name", "state", "entity_id")
    raised = every.join(gains(records, known_names, weight), "id", "left").withColumn("record_count", F.coalesce("record_count", F.lit(0)) + F.coalesce("gained", F.lit(0))).drop("gained")
    return {"decisions": decided.select("name", "state", "entity_id", "layer"), "entities": raised, "records": backfill_by_name(records, known_names), "stats": decided.groupBy("layer").agg(F.count("*").alias("n"))}


def gains(records: DataFrame, resolved: DataFrame, weight: str | None = None) -> DataFrame:
    """(id, gained): how many records without an entity get each by backfill_by_name. Those of one name and state are looked up once."""
    kind, n = dict(records.dtypes)["canonical_employer_id"], F.sum(weight) if weight else F.count("*")
    names = records.where("canonical_employer_id IS NULL").groupBy(F.lower("employer_name").alias("employer_name"), "employer_state").agg(n.alias("gained"))
    found = backfill_by_name(names.withColumn("canonical_employer_id", F.lit(None).cast(kind)), resolved).where("canonical_employer_id IS NOT NULL")
    return found.groupBy(F.col("canonical_employer_id").alias("id")).agg(F.sum("gained").alias("gained"))


def raise_counts(entities: DataFrame, before: DataFrame, after: DataFrame) -> DataFrame:
    """entities with record_count raised by the records that have their id after, but not before."""
    count = lambda df, sign: df.where("canonical_employer_id IS NOT NULL").groupBy(F.col("canonical_employer_id").alias("id")).agg((sign * F.count("*")).alias("_n"))
    gained = count(after, 1).unionAll(count(before, -1)).groupBy("id").agg(F.sum("_n").alias("_n"))
    return entities.join(gained, "id", "left").withColumn("record_count", F.coalesce("record_count", F.lit(0)) + F.greatest(F.coalesce("_n", F.lit(0)), F.lit(0))).drop("_n")


def unresolved_decisions(queue: DataFrame, entities: DataFrame, records: DataFrame, decisions: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(records, entities, queue) after a log of decisions on open rows of the queue (id, name, state, fein, resolved_at, resolved_to_id).

    decisions: decision_id, id, action, entity_id, name, decided_at; the latest on a row counts. merge takes a known entity and
    leaves the row open if there is none; create takes the entity that has the row's employer id, else inserts one with the given
    name or the row's own; reject closes the row without an entity. merge and create write the entity's id to records without one by
    lower-cased name and, if the row has one, state; the entity's record_count grows by as many.
    """
    kind = dict(entities.dtypes)["id"]
    d = latest(decisions, ["id"]).select("id", "action", F.col("entity_id").alias("_to"), F.trim(F.col("name")).alias("_name"), F.col("decided_at").alias("_at"))
    rows = queue.where("resolved_at IS NULL").select("id", "name", "state", "fein").join(d, "id")
    merged = rows.where("action = 'merge'").join(entities.select(F.col("id").alias("_to")).distinct(), "_to", "left_semi")
    by_fein = entities.where("fein IS NOT NULL").groupBy("fein").agg(F.min("id").alias("_known"))
    made = rows.where("action = 'create'").drop("_to").join(by_fein, "fein", "left")
    digest = F.sha2(F.concat_ws("|", F.lit("queue"), F.coalesce("fein", F.col("id").cast("string"))), 256).cast(kind)
    made = made.withColumns({"_to": F.coalesce("_known", digest), "_name": F.coalesce("_name", F.trim("name"))})
    first = F.min(F.struct("id", F.col("_name").alias("canonical_name"), F.col("state").alias("employer_state"), "fein"))
    new = made.where("_known IS NULL").groupBy("_to").agg(first.alias("f")).select(F.col("_to").alias("id"), "f.canonical_name", "f.employer_state", "f.fein", F.lit(0).cast("long").alias("record_count"))
    done = merged.select("id", "name", "state", "_to", "_at").unionByName(made.select("id", "name", "state", "_to", "_at"))
    written = backfill_by_name(records, done.select("name", "state", F.col("_to").alias("entity_id")))
    every = raise_counts(entities.select("id", "canonical_name", "employer_state", "fein", F.col("record_count").cast("long").alias("record_count")).unionByName(new), records, written)
    closed = done.select("id", "_to", "_at").unionByName(rows.where("action = 'reject'").select("id", F.lit(None).cast(kind).alias("_to"), "_at"))
    out = queue.join(closed.withColumn("_done", F.lit(True)), "id", "left")
    out = out.withColumns({"resolved_at": F.coalesce("resolved_at", "_at"), "resolved_to_id": F.when(F.col("_done"), F.col("_to")).otherwise(F.col("resolved_to_id"))}).drop("_to", "_at", "_done")
    return written, every, out


def unresolved_queue(records: DataFrame, order: list[str]) -> DataFrame:
    """Misses by normalized name and state, with hits, first record and first known id."""
    rows = records.where("canonical_employer_id IS NULL").withColumns({"name_norm": F.lower("employer_name"), "state_norm": F.coalesce("employer_state", F.lit(""))})
    first = F.struct(*order)
    return rows.groupBy("name_norm", "state_norm").agg(F.count("*").alias("hits"), F.min_by("record_id", first).alias("first_record"), F.min("filing_year").alias("first_year"), F.min_by("employer_fein", F.when(F.col("employer_fein").isNotNull(), first)).alias("fein"))


def merge_queue(queue: DataFrame, new: DataFrame) -> DataFrame:
    return upsert(queue, new, ["name_norm", "state_norm"], "nothing", counters=("hits",))


def backfill_by_name(records: DataFrame, resolved: DataFrame) -> DataFrame:
    """Entity ids for records without one by lower-cased name; a resolved row without a state fits any state.

    Two equi joins, for rows with and without a state, in place of one with OR; the row with a state wins.
    """
    r = resolved.select(F.lower("name").alias("_n"), F.col("state").alias("_s"), F.col("entity_id").alias("_e"))
    exact = r.where("_s IS NOT NULL").groupBy("_n", "_s").agg(F.min("_e").alias("_e1"))
    any_ = r.where("_s IS NULL").groupBy("_n").agg(F.min("_e").alias("_e2")).withColumnRenamed("_n", "_m")
    out = records.join(exact, (F.lower("employer_name") == F.col("_n")) & (F.col("employer_state") == F.col("_s")), "left").join(any_, F.lower("employer_name") == F.col("_m"), "left")
    new = F.coalesce("canonical_employer_id", "_e1", "_e2")
    return out.withColumn("canonical_employer_id", new).drop("_n", "_s", "_e1", "_m", "_e2")


def similar_entities(entities: DataFrame, name: str, state: str | None = None, floor: float = 0.3, limit: int = 20) -> DataFrame:
    """Ranked candidates for a name, of equally similar ones those with more records first; entities without a state pass any state."""
    rows = entities.where(F.col("employer_state").isNull() | (F.col("employer_state") == state)) if state else entities
    rows = rows.withColumn("sim", jaccard(trigrams(F.col("canonical_name")), trigrams(F.lit(name)))).where(F.col("sim") >= floor)
    records = [F.desc_nulls_last("record_count")] if "record_count" in entities.columns else []
    return rows.orderBy(F.desc("sim"), *records, "id").limit(limit)


def layer_mix(entities: DataFrame, queue: DataFrame) -> DataFrame:
    """One row: entities with and without an employer id, and rows of the queue that were merged or are open."""
    left = entities.agg(F.count("fein").alias("with_id"), F.count_if(F.col("fein").isNull()).alias("by_name"))
    right = queue.agg(F.count_if(F.col("resolved_at").isNotNull() & F.col("resolved_to_id").isNotNull()).alias("merged"), F.count_if(F.col("resolved_at").isNull()).alias("open"))
    return left.join(right)  # one row each


@lru_cache(1 << 18)
def _component(gram: str, dim: int) -> int:
    return int(hashlib.md5(gram.encode("utf-8", "replace")).hexdigest()[:8], 16) % dim


def embed(rows: DataFrame, text: str, dim: int = 64) -> DataFrame:
    """Unit vectors of hashed trigrams, the default encoder: rows with a column v. Any function of frames with the same columns can
    replace it. A text without trigrams, null among them, gets zeros.

    Trigrams come from the JVM; the vectors are filled in Arrow batches, so that no later expression computes them again.
    """

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = np.zeros((batch.num_rows, dim))
            for k, grams in enumerate(batch.column(batch.num_columns - 1).to_pylist()):
                if grams:
                    v[k] = np.bincount([_component(g, dim) for g in grams], minlength=dim)
            v /= np.maximum(np.sqrt((v * v).sum(axis=1)), 1e-12)[:, None]
            lists = pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1) * dim, pa.int32()), pa.array(v.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], lists], [*batch.schema.names[:-1], "v"])

    rows = rows.drop("v")
    return rows.withColumn("_g", trigrams(F.col(text))).mapInArrow(fill, StructType([*rows.schema.fields, StructField("v", ArrayType(DoubleType()))]))


def embed_pending(entities: DataFrame, vectors: DataFrame, version: str, encoder: Encoder | None = None, max_rows: int = 0) -> DataFrame:
    """vectors (id, v, model_version) and those of the entities that have none of this version yet: the first max_rows by id, or all (0)."""
    missing = entities.join(vectors.where(F.col("model_version") == version).select("id"), "id", "left_anti")
    missing = missing.orderBy("id").limit(max_rows) if max_rows else missing
    return vectors.select("id", "v", "model_version").unionByName((encoder or embed)(missing, "canonical_name").select("id", "v", F.lit(version).alias("model_version")))
