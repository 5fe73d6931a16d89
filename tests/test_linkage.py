"""Set similarity and nearest vectors: exact against brute force, and how much they look at."""

import random

import pytest
from pyspark.sql import functions as F

from lodestar.functions.scalar import trigrams
from lodestar.operators import linkage as K


def grams(name):
    import re

    out = set()
    for w in re.split(r"[\W_]+", name.lower()):
        if w:
            p = f"  {w} "
            out |= {p[k : k + 3] for k in range(len(p) - 2)}
    return out


def similar(a, b, theta):
    x, y = grams(a), grams(b)
    return bool(x and y) and len(x & y) / len(x | y) >= theta


def small_vocabulary(n, words, seed):
    """Texts of few syllables, where no gram is rare, and near copies of them."""
    rng = random.Random(seed)
    parts = ["ta", "re", "mi", "lo", "su", "ne", "ka", "vi"]
    word = lambda: "".join(rng.choices(parts, k=rng.randint(1, 3)))
    out = [" ".join(word() for _ in range(rng.randint(words // 2, words))) for _ in range(n * 3 // 4)]
    return out + [rng.choice(out) + " " + word() for _ in range(n - len(out))]


def test_trigrams_of_odd_names(spark):
    names = ["", " ", "a", "A b", "ab", "é ß", "日本 語", "x-y_z", "a1 2b", "Ab ab AB", "\U0001d400b c", "don't"]
    rows = spark.createDataFrame([(x,) for x in names] + [(None,)], "s string").select("s", trigrams(F.col("s")).alias("g")).collect()
    for r in rows:
        if r.s is None:
            assert r.g is None
        elif "_" not in r.s and "\U0001d400" not in r.s:
            assert set(r.g) == grams(r.s) and len(r.g) == len(set(r.g)), r.s


@pytest.mark.parametrize("theta", [0.3, 0.6, 0.85, 1.0])
def test_pairs_equal_brute_force(spark, theta):
    names = [*small_vocabulary(60, 12, 1), "", "a", "b", "a b", "b a"]
    rows = spark.createDataFrame(list(enumerate(names)), "id long, name string")
    got = sorted((min(r.left_id, r.right_id), max(r.left_id, r.right_id)) for r in K.similar_pairs(rows, theta).collect())
    assert got == [(a, b) for a in range(len(names)) for b in range(a + 1, len(names)) if similar(names[a], names[b], theta)]


def test_join_with_blocks_equals_brute_force(spark):
    rng, names = random.Random(2), small_vocabulary(80, 6, 3)
    left = [(k, x, rng.choice(["A", "B", None])) for k, x in enumerate(names[:40])]
    right = [(k, x, rng.choice(["A", "B", None])) for k, x in enumerate(names[40:] + names[:10])]
    frame = lambda rows: spark.createDataFrame(rows, "id long, name string, state string")
    got = sorted((r.left_id, r.right_id) for r in K.set_similarity_join(frame(left), frame(right), 0.7, "state").collect())
    assert got == [(i, j) for i, a, s in left for j, b, t in right if (s is None or s == t) and similar(a, b, 0.7)]


def test_common_postings_are_cut_and_few_candidates_leave(spark):
    names = small_vocabulary(300, 60, 4)
    sets = K._sets(spark.createDataFrame(list(enumerate(names)), "id long, name string"), 0, F.lit(0).cast("long"))
    ids = {r.r: r.id for r in sets.collect()}
    truth = {(a, b) for a in range(300) for b in range(a + 1, 300) if similar(names[a], names[b], 0.85)}
    for chunk in (16, 4096):
        met = {tuple(sorted((ids[r.a], ids[r.b]))) for r in K.similarity_candidates(sets, 0.85, False, chunk).collect()}
        assert truth <= met and len(met) < 300 * 299 / 2 / 20


def brute_nearest(queries, base, k, others=False, label=False):
    import numpy as np

    out = []
    for i, q in queries:
        if q is None or not any(q):
            continue
        sims = []
        for j, v, lab in base:
            if v is not None and any(v) and len(v) == len(q) and not (others and i == j):
                x, y = np.array(q, float), np.array(v, float)
                sims.append((-round(float(x @ y / np.sqrt(x @ x) / np.sqrt(y @ y)), 6) or 0.0, j, lab))
        best, seen = [], set()
        for s, j, lab in sorted(sims):
            if not label or lab not in seen:
                seen.add(lab)
                best.append((i, j, -s))
        out += best[:k]
    return sorted(out)


@pytest.mark.parametrize("label", [None, "label"])
def test_chunks_left_out_change_nothing(spark, label):
    rng = random.Random(7)
    centres = [[rng.gauss(0, 1) for _ in range(5)] for _ in range(12)]
    near = lambda c: [round(x + rng.gauss(0, 0.05), 3) for x in c]
    base = [(k, near(centres[k % 12]), str(k % 7)) for k in range(400)] + [(400, None, "0"), (401, [0.0] * 5, "0"), (402, [1.0, 2.0], "1"), (403, [2.0, 4.0], "2"), (404, [1.0], "3")]
    base += [(500 + k, [0.5] * 5, str(k)) for k in range(40)]  # one vector many times
    queries = [(k, v) for k, v, _ in base[::13]] + [(900, [2.0, 1.0]), (901, None), (902, [0.0] * 5), (903, [1.0] * 9)]
    frame, asked = spark.createDataFrame(base, "id long, v array<double>, label string"), spark.createDataFrame(queries, "id long, v array<double>")
    for others in (False, True):
        want = brute_nearest(queries, base, 3, others, bool(label))
        for chunk in (10_000, 30):
            got = K.nearest_vectors(asked, frame, 3, chunk=chunk, others=others, label=label, pivots=20)
            assert sorted((r.query_id, r.base_id, r.sim) for r in got.collect()) == want


def test_bounds_leave_out_most_of_clustered_vectors(spark):
    rng = random.Random(8)
    centres = [[rng.gauss(0, 1) for _ in range(16)] for _ in range(30)]
    base = [(f"b{k}", [x + rng.gauss(0, 0.02) for x in centres[k % 30]], "") for k in range(3000)]
    queries, count = [(i, v) for i, v, _ in base[::20]], spark.sparkContext.accumulator(0)
    frame = spark.createDataFrame(base, "id string, v array<double>, label string")
    got = K.nearest_vectors(frame.where(F.substring("id", 2, 9).cast("int") % 20 == 0), frame, 3, chunk=100, others=True, count=count)
    assert sorted((r.query_id, r.base_id, r.sim) for r in got.collect()) == brute_nearest(queries, base, 3, True)
    assert count.value < len(base) * len(queries) / 4


def test_copies_of_entities_are_compared_once_and_the_smallest_id_wins(spark, monkeypatch):
    entities = spark.createDataFrame([(f"e{c}-{k}", None, f"Steel works {k * 7919}", "A") for c in range(50) for k in range(8)], "id string, fein string, canonical_name string, employer_state string")
    names = spark.createDataFrame([(f"n{c}-{k}", f"STEEL works {k * 7919}", None, s) for c in range(20) for k in range(8) for s in ("A", "B", None)], "id string, name string, fein string, state string").select(F.concat_ws(":", "id", F.coalesce("state", F.lit("-"))).alias("id"), "name", "fein", "state")
    met = []
    whole, near = K.similarity_candidates, K.nearest_vectors
    monkeypatch.setattr(K, "similarity_candidates", lambda sets, *a: met.append(sets.count()) or whole(sets, *a))
    monkeypatch.setattr(K, "nearest_vectors", lambda q, b, *a, **k: met.append(b.count()) or near(q, b, *a, **k))
    got = {r.id: (r.entity_id, r.layer) for r in K.resolve(names, entities, vector_layer=K.resolve_by_vector).collect()}
    want = {f"n{c}-{k}:{s}": (f"e0-{k}", "vector" if s == "B" else "trigram") for c in range(20) for k in range(8) for s in "AB-"}
    assert got == want and met == [8 + 3 * 8, 8]


def test_a_floor_loses_nothing_above_it(spark):
    rng = random.Random(11)
    base = [(k, [rng.gauss(0, 1) for _ in range(4)], "") for k in range(500)]
    queries, counts = [(k, [rng.gauss(0, 1) for _ in range(4)]) for k in range(80)], []
    frame, asked = spark.createDataFrame(base, "id long, v array<double>, label string"), spark.createDataFrame(queries, "id long, v array<double>")
    want = [r for r in brute_nearest(queries, base, 1) if r[2] >= 0.97]
    for floor in (-2.0, 0.97):
        for chunk in (10_000, 20):
            counts.append(spark.sparkContext.accumulator(0))
            got = K.nearest_vectors(asked, frame, 1, chunk=chunk, pivots=20, floor=floor, count=counts[-1])
            assert sorted((r.query_id, r.base_id, r.sim) for r in got.where("sim >= 0.97").collect()) == want
    assert counts[3].value < counts[1].value


@pytest.mark.parametrize("chunk", [8, 8192])
def test_similar_sets_are_counted_in_tiles_and_no_pair_leaves(spark, monkeypatch, chunk):
    from lodestar.operators import tiles

    names = [*small_vocabulary(120, 30, 5), *small_vocabulary(60, 6, 6), "", "\U0001d400b ü", "Ü \U0001d400B"]
    names += names[:9]
    whole = tiles.similar_counts
    monkeypatch.setattr(tiles, "SLICE", 64)
    monkeypatch.setattr(K, "similar_counts", lambda sets, theta: whole(sets, theta, chunk))
    monkeypatch.setattr(K, "_verified", lambda *a: pytest.fail("pairs were dealt out"))
    rows = spark.createDataFrame(list(enumerate(names)) + [(999, None)], "id long, name string")
    got = {r.id: (r.class_id, r.links) for r in K.similarity_classes(rows, 0.85).collect()}
    same = lambda a, b: grams(a) == grams(b) if grams(a) or grams(b) else False
    for i, a in enumerate(names):
        assert got[i][1] == sum(i != j and similar(a, b, 0.85) for j, b in enumerate(names)), a
        assert all((got[i][0] is not None and got[i][0] == got[j][0]) == same(a, b) for j, b in enumerate(names) if i != j)
    assert got[999] == (None, 0) and len(got) == len(names) + 1


def test_rows_of_one_side_or_of_unlike_blocks_are_not_compared(monkeypatch):
    import numpy as np
    import pyarrow as pa

    asked, known, blocks = 3000, 100, 25
    n = asked + known
    columns = {"g": [7] * n, "lo": [0] * n, "hi": [0] * n, "c": [0] * n, "place": [0] * n, "r": list(range(n)), "side": [0] * asked + [1] * known, "size": [19] * n}
    columns |= {"block": [k % blocks for k in range(n)], "bits": [bytes(64)] * n}
    compared = []
    whole = K._least_overlap
    monkeypatch.setattr(K, "_least_overlap", lambda theta, sizes: compared.append(np.size(sizes)) or whole(theta, sizes))
    got = K._met(0.85, True, pa.table(columns)).to_pylist()
    want = {(a, b) for a in range(asked) for b in range(asked, n) if a % blocks == b % blocks}
    assert {(x["a"], x["b"]) for x in got} == want and len(got) == len(want) and sum(compared) <= 2 * len(want)


def test_a_chunk_that_many_queries_go_to_is_dealt_out(spark, monkeypatch):
    from lodestar.operators import nearest

    rng = random.Random(12)
    base = [(k, [rng.gauss(0, 1) for _ in range(3)], "") for k in range(60)]
    queries = [(k, [rng.gauss(0, 1) for _ in range(3)]) for k in range(300)]
    frame, asked = spark.createDataFrame(base, "id long, v array<double>, label string"), spark.createDataFrame(queries, "id long, v array<double>").repartition(8)
    want = brute_nearest(queries, base, 2)
    for share in (1 << 16, 20):
        monkeypatch.setattr(nearest.Search, "share", share)
        got = K.nearest_vectors(asked, frame, 2, chunk=30, pivots=5)
        assert sorted((r.query_id, r.base_id, r.sim) for r in got.collect()) == want


def test_tiles_are_done_in_waves_whose_shuffles_go(spark, monkeypatch):
    from lodestar.operators import tiles

    names = small_vocabulary(160, 30, 9)
    whole, seen = tiles.similar_counts, []

    def waves(sets, theta):
        out = whole(sets, theta, 8)
        seen.append(len({f.split("-", 2)[-1].split("-c0")[0] for f in (x.rsplit("/", 1)[1] for x in out.inputFiles())}))
        return out

    monkeypatch.setattr(K, "similar_counts", waves)
    rows, got = spark.createDataFrame(list(enumerate(names)), "id long, name string"), []
    for most, partners in ((1 << 28, 8), (1, 2)):
        monkeypatch.setattr(tiles, "WAVE", most)
        monkeypatch.setattr(tiles, "PARTNERS", partners)
        got.append({r.id: r.links for r in K.similarity_classes(rows, 0.85).collect()})
    assert got[0] == got[1] == {i: sum(i != j and similar(a, b, 0.85) for j, b in enumerate(names)) for i, a in enumerate(names)}
    assert seen[0] == 1 and seen[1] >= 3
