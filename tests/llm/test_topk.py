import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from helixframe.llm import topk as T


def whole(x):
    return math.floor(max(-9223372036854774784, min(9223372036854774784, 1024 * x)))


def brute(rows, k=10):
    fine = [(i, [whole(x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for n, (q, a) in enumerate(fine):
        if q % 100 == 0:
            best = sorted((-sum(x * y for x, y in zip(a, b, strict=True)), i) for m, (i, b) in enumerate(fine) if m != n and len(a) == len(b))[:k]
            out += [(q, r + 1, i, max(-(1 << 63), min((1 << 63) - 1, -s))) for r, (s, i) in enumerate(best)]
    return sorted(out)


@pytest.mark.parametrize("values", [(1 << 19, 1 << 16), (320, 16)])
def test_equals_brute_force(spark, values):
    rnd = random.Random(values[0])
    vec = lambda n: [float(np.float32(rnd.gauss(0, 1))) for _ in range(n)]
    centre = vec(8)
    rows = [(i, vec(8)) for i in range(300)] + [(i, [c + rnd.gauss(0, 0.01) for c in centre]) for i in range(300, 500)] + [(i, centre) for i in range(500, 640)]
    rows += [(700, None), (800, [None] + vec(7)), (801, [math.nan] * 8), (802, [math.inf] * 8), (900, vec(3)), (901, vec(3)), (1000, []), (1001, []), (None, vec(8)), (5, rows[5][1]), (6, vec(8)), (100, vec(8)), (200, rows[200][1])]
    df = spark.createDataFrame([(i, v, 1.0) for i, v in rows], "vec_id long, embedding array<double>, score double")
    got = sorted(tuple(r) for r in T.nearest(df, F.col("vec_id") % 100 == 0, block_values=values[0], query_values=values[1]).collect())
    assert got == brute(rows)


def test_groups_of_many_queries_are_pruned():
    """Clustered vectors: pairs are cut at nodes of queries that have children."""
    rnd = np.random.default_rng(3)
    centres = rnd.normal(size=(40, 16)) * 1000
    data = np.floor(centres[rnd.integers(0, 40, 4000)] + rnd.normal(size=(4000, 16)) * 20).astype(np.int64)
    rows = np.arange(4000)
    queries = T.CoverTree.build(rows[::5], rows[::5], data[::5])
    found = T.Search(queries, T.CoverTree.build(rows, rows, data), 10)
    assert queries.last[0] > 0 and found.cut[0] > 100
    scores = data[::5] @ data.T
    for n in range(0, 800, 37):
        best = sorted((-int(s), i) for i, s in enumerate(scores[n]) if i != 5 * n)[:10]
        assert [(-int(s), int(i)) for s, i in zip(found.scores[n], found.found[n], strict=True)] == best


def test_components_of_any_size(spark):
    rows = [(0, [1e300, -1.0]), (1, [1e9, 2.0]), (2, [-1e300, 5.0]), (3, [1e300, 1e9]), (4, [3.0, 1e308]), (5, [0.5, 0.25]), (6, [1e9, 2.0]), (100, [1e300, 1e300])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted(tuple(r) for r in T.nearest(df, F.col("vec_id") % 100 == 0, block_values=6, query_values=2).collect())
    assert got == brute(rows)


def test_no_rows(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert T.nearest(df, F.col("vec_id") % 100 == 0).count() == 0


def test_cover_tree():
    rnd = np.random.default_rng(0)
    v = (rnd.normal(size=(500, 5)) * 100).astype(np.int64)
    t = T.CoverTree.build(np.arange(500), np.arange(500), v)
    for i in range(len(t.centre)):
        own = t.order[t.begin[i] : t.end[i]]
        assert np.sqrt(((v[own] - v[t.centre[i]]) ** 2).sum(axis=1)).max() <= t.radius[i] + 1e-9
        if t.last[i]:
            kids = t.centre[t.first[i] : t.last[i]]
            d = np.sqrt(((v[kids][:, None] - v[kids][None]) ** 2).sum(axis=2)) + np.eye(len(kids)) * 1e9
            assert d.min() > t.radius[i] / 2 and sorted(np.concatenate([t.order[t.begin[c] : t.end[c]] for c in range(t.first[i], t.last[i])])) == sorted(own)


def test_large_components_stay_exact(spark):
    rows = [(0, [2e6, 1.0]), (1, [2e6, 5.0]), (2, [1e6, -7.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    a, b = int(2e6) * 1024, int(1e6) * 1024
    assert {tuple(r) for r in T.nearest(df, F.col("vec_id") == 1).collect()} == {(1, 1, 0, a * a + 5 * 1024 * 1024), (1, 2, 2, a * b - 35 * 1024 * 1024)}
