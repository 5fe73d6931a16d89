"""Hard negatives against brute force; pruning, ties, repeats and odd rows."""

import numpy as np
import pytest

from lodestar.llm import imi

FIELDS = "id long, v array<long>, label long"


def brute(rows, anchors, low=80, k=5):
    dims = [len(r[1]) for r in rows if None not in r and r[1]]
    if not dims:
        return []
    dim = max(set(dims), key=lambda d: (dims.count(d), d))
    rows, anchors = ([r for r in t if None not in r and len(r[1]) == dim] for t in (rows, anchors))
    end, out = 2**63 - 1, []
    dot = lambda a, b: max(-end, min(end, sum(x * y for x, y in zip(a, b, strict=True))))
    for i, v, label in anchors:
        own, good, bad = 0, [], []
        for j, x, other in rows:
            s = dot(v, x)
            if other != label:
                bad.append((-s, j))
            elif j == i and s == dot(v, v) and not own:
                own = 1
            else:
                good.append((-s, j))
        for p, j in sorted(good)[:k]:
            some = sorted((n, b) for n, b in bad if low * -p <= 100 * -n <= 100 * -p)[:k]
            out += [(i, j, r + 1, b, -p, -n) for r, (n, b) in enumerate(some)]
    return sorted(out)


def got(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize("dim", [1, 2, 7])
def test_equals_brute_force(spark, dim):
    rng = np.random.default_rng(dim)
    rows = [(k % 280, rng.integers(-6, 9, dim).tolist(), int(rng.integers(0, 3))) for k in range(300)]
    anchors = rows[::17] + rows[17:18] + [(9999, [3] * dim, 1), (9998, [0] * dim, 5)]
    frame = spark.createDataFrame(rows, FIELDS)
    df = imi.hard_negatives(frame, spark.createDataFrame(anchors, FIELDS), codes=4, sample=50, shard_rows=40, block=3)
    assert got(df) == brute(rows, anchors)


def test_odd_rows(spark):
    big = 2**40
    rows = [(1, [1, 2], 0), (1, [1, 2], 0), (2, None, 0), (None, [1, 2], 0), (3, [1, 2], None), (4, [1, 2, 3], 0), (5, [], 0), (6, [2, 2], 1), (7, [1, 3], 0), (8, [-1, -2], 0), (9, [big, -big], 1), (10, [big, 1 - big], 0), (11, [big, -big], 0), (12, [-big, big], 0)]
    frame = spark.createDataFrame([(*r, 1, 2) for r in rows], FIELDS + ", shard long, kind int")
    assert got(imi.hard_negatives(frame, frame, shard_rows=3, codes=2)) == brute(rows, rows)
    assert imi.hard_negatives(frame.limit(0), frame).count() == 0 == imi.hard_negatives(frame, frame.limit(0)).count()


def test_one_vector_a_third_of_all(spark):
    rng = np.random.default_rng(3)
    rows = [(k, [5, 5, 5, 5] if k % 3 == 0 else rng.integers(-9, 9, 4).tolist(), k % 2) for k in range(240)]
    frame = spark.createDataFrame(rows, FIELDS)
    assert got(imi.hard_negatives(frame, frame.where("id % 20 = 0"), shard_rows=16, codes=4)) == brute(rows, rows[::20])


def test_prunes_clusters(spark):
    rng = np.random.default_rng(4)
    centres = rng.integers(-2000, 2000, (40, 16))
    rows = [(k, (centres[k % 40] + rng.integers(-20, 20, 16)).tolist(), k // 40 % 2) for k in range(4000)]
    frame, count = spark.createDataFrame(rows, FIELDS), spark.sparkContext.accumulator(0)
    anchors = rows[::100]
    assert got(imi.hard_negatives(frame, frame.where("id % 100 = 0"), shard_rows=500, count=count)) == brute(rows, anchors)
    assert count.value < len(rows) * len(anchors) / 2  # the two searches together could meet every row once


def test_cells_come_by_falling_bounds():
    rng = np.random.default_rng(5)
    v = rng.integers(-50, 50, (300, 6))
    books = tuple(imi.codebook(p.astype(float), 5) for p in imi.halves(v))
    codes = np.array([imi.nearest(p.astype(float), b) for p, b in zip(imi.halves(v), books, strict=True)], np.int32)
    order = np.lexsort((codes[1], codes[0]))
    v, codes = v[order], codes[:, order]
    shard = imi.Shard(np.arange(300), np.zeros(300, np.int64), v, codes, imi.radii(v, codes, books), books)
    for q in v[:20]:
        cells = list(shard.cells_by_bound(q))
        assert sorted(x for _, _, a, b in cells for x in range(a, b)) == list(range(300))
        assert [c[0] for c in cells] == sorted((c[0] for c in cells), reverse=True)
        for up, low, a, b in cells:
            assert low - 1e-6 <= (v[a:b] @ q).min() and (v[a:b] @ q).max() <= up + 1e-6
