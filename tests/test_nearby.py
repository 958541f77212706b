"""Nearest vectors with blocks left out, against plain numpy and the search that meets all blocks."""

import numpy as np
import pytest

from palimpsest.operators import nearby, semantic


def plain(v, q, k):
    out = {}
    for n, w in enumerate(q):
        total = np.zeros(len(v))
        for d in range(v.shape[1]):
            total += w[d] * v[:, d]
        out[n] = [int(i) for i in np.lexsort((np.arange(len(v)), -total))[:k]]
    return out


def frames(spark, v, q):
    return spark.createDataFrame([(i, x) for i, x in enumerate(v.tolist())], "id long, embedding array<double>"), spark.createDataFrame([(i, x) for i, x in enumerate(q.tolist())], "query_id long, embedding array<double>")


@pytest.mark.parametrize("kind", ["clusters", "anywhere", "lengths"])
def test_nearest_is_exact(spark, kind):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(12, 8))
    v = centres[rng.integers(0, 12, 1200)] + 0.05 * rng.normal(size=(1200, 8)) if kind == "clusters" else rng.normal(size=(1200, 8))
    v = v * rng.exponential(1, (1200, 1)) if kind == "lengths" else v / np.linalg.norm(v, axis=1)[:, None]
    v[100:130] = v[99]  # equal ones go by id
    q = np.vstack([v[::40], rng.normal(size=(3, 8))])
    found, counts = nearby.nearest(*frames(spark, v, q), 5, block=32, pivots=16)
    got = {}
    for r in found.orderBy("query_id", "place").collect():
        got.setdefault(r.query_id, []).append(r.id)
    assert got == plain(v, q, 5)
    # near vectors leave most pairs unmet
    assert counts["met"] < counts["pairs"] * (0.35 if kind == "clusters" else 1.01)


def test_few_vectors_and_none(spark):
    v, q = np.eye(3), np.array([[1.0, 0.2, 0.1]])
    a, b = frames(spark, v, q)
    assert sorted((r.id, r.place) for r in nearby.nearest(a, b, 9)[0].collect()) == [(0, 1), (1, 2), (2, 3)]
    assert nearby.nearest(a.limit(0), b, 2)[0].count() == 0 and nearby.nearest(a, b.limit(0), 2)[0].count() == 0
    whole = sorted(map(tuple, semantic.nearest(a, b, 2).collect()))
    assert sorted(map(tuple, nearby.nearest(a, b, 2)[0].collect())) == whole
