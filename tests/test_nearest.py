"""Nearest rows against brute force: copies, clusters, crowded cells, few rows."""

import numpy as np
import pytest

from scoreloom.operators import vectors as vec


def table(spark, x, first=0):
    return spark.createDataFrame([(first + i, [float(v) for v in row]) for i, row in enumerate(x)], "vec_id long, embedding array<float>")


def plain(q, r, k):
    out = {}
    for i, x in enumerate(q):
        d = np.sqrt(((r - x) ** 2).sum(axis=1))
        out[10_000 + i] = [(int(j), d[j]) for j in np.lexsort((np.arange(len(r)), d))[:k]]
    return out


@pytest.mark.parametrize("k", [1, 7, 80])
def test_equals_brute_force(spark, monkeypatch, k):
    monkeypatch.setattr(vec, "PER_CELL", 6)
    rng = np.random.default_rng(k)
    centres = rng.normal(0, 20, (12, 6))
    r = np.float32(np.vstack([c + rng.normal(0, 1, (25, 6)) for c in centres]))
    r[40:110] = r[3]  # copies fill a cell and the k-th place
    q = np.float32(np.vstack([r[:20], centres + 0.5, rng.normal(0, 40, (5, 6))])).astype(float)
    r = r.astype(float)
    rows = vec.nearest(table(spark, q, 10_000), table(spark, r), "vec_id", k=k, block=16).collect()
    want = plain(q, r, k)
    assert len(rows) == len(want)
    for row in rows:
        assert [n["id"] for n in row.top] == [j for j, _ in want[row.vec_id]]
        assert np.allclose([n["d"] for n in row.top], [d for _, d in want[row.vec_id]])
    assert k > 7 or sum(row.visited for row in rows) < 0.5 * len(q) * len(r)


def test_few_or_no_rows(spark):
    q, none = table(spark, [[0.0, 1.0]]), table(spark, [[1.0, 1.0]]).where("false")
    assert [r.top for r in vec.nearest(q, none, "vec_id", k=3).collect()] == [[]]
    assert [n["id"] for n in vec.nearest(q, table(spark, [[5.0, 1.0], [1.0, 1.0]]), "vec_id", k=3).first().top] == [1, 0]
    assert vec.nearest(none, q, "vec_id").count() == 0


def test_highest_cosine(spark):
    rng = np.random.default_rng(0)
    q, r = rng.normal(size=(9, 4)), rng.normal(size=(60, 4))
    q[0] = 0
    got = {x.vec_id: x.cos_max for x in vec.nearest_cosine(table(spark, q), table(spark, r), "vec_id").collect()}
    unit = lambda a: a / np.maximum(np.linalg.norm(a, axis=1, keepdims=True), 1e-30)
    want = (unit(q.astype(np.float32).astype(float)) @ unit(r.astype(np.float32).astype(float)).T).max(axis=1)
    want[0] = 0
    assert np.allclose([got[i] for i in range(9)], want, atol=1e-9)


def test_moments_of_wide_vectors(spark, monkeypatch):
    """768 coordinates, more tasks than are merged at once, some tasks empty, far from zero."""
    monkeypatch.setattr(vec, "FAN_IN", 3)
    rng = np.random.default_rng(6)
    x = rng.normal(1000, 1, (300, 768))
    df = spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "vec_id long, embedding array<double>").repartition(11, "vec_id").unionAll(table(spark, [[0.0] * 768]).selectExpr("vec_id", "cast(null as array<double>)"))
    rows = vec.moments(df, "embedding").orderBy("i").collect()
    assert np.allclose([r.mean for r in rows], x.mean(axis=0), atol=1e-9) and np.allclose([r.variance for r in rows], x.var(axis=0), rtol=1e-9)
    n, outer, fourth = vec.gram(df, "embedding", x.mean(axis=0))
    z = x - x.mean(axis=0)
    assert n == 300 and np.allclose(outer, z.T @ z) and fourth == pytest.approx(((z * z).sum(axis=1) ** 2).sum())
