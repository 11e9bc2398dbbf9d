"""Nearest rows by groups: what is sent, copies and repeated ids."""

import numpy as np

from scoreloom.operators import vectors as vec


def table(spark, x, ids):
    return spark.createDataFrame([(int(i), [float(v) for v in row]) for i, row in zip(ids, x, strict=True)], "vec_id long, embedding array<float>")


def test_vectors_are_sent_once_per_group_of_cells(spark, monkeypatch):
    """Where no cell can be left out, a query goes to each group of reference rows, not to each cell."""
    monkeypatch.setattr(vec, "PER_CELL", 10)
    rng = np.random.default_rng(1)
    q, r = rng.normal(size=(40, 16)), rng.normal(size=(600, 16))
    frames, kind = [], type(spark.range(0))
    plain = kind.mapInPandas
    monkeypatch.setattr(kind, "mapInPandas", lambda self, f, schema, *a, **b: frames.append(plain(self, f, schema, *a, **b)) or frames[-1])
    got = {x.vec_id: [n["id"] for n in x.top] for x in vec.nearest(table(spark, q, range(1000, 1040)), table(spark, r, range(600)), "vec_id", k=9, block=150).collect()}
    q, r = q.astype(np.float32).astype(float), r.astype(np.float32).astype(float)
    assert got == {1000 + i: np.argsort(((r - x) ** 2).sum(axis=1), kind="stable")[:9].tolist() for i, x in enumerate(q)}
    sent = [f for f in frames if "v" in f.columns][-1]
    assert sent.count() <= 40 * 8


def test_copies_and_repeated_ids(spark, monkeypatch):
    """A crowd of one vector is cut into groups; rows that share an id each count."""
    monkeypatch.setattr(vec, "PER_CELL", 20)
    rng = np.random.default_rng(2)
    r = np.vstack([rng.integers(0, 4, (60, 3)), np.tile([1, 1, 1], (140, 1))]).astype(float)
    ids = np.append(np.arange(150), np.arange(50))
    q = np.vstack([r[:9], [[1, 1, 1]], [[1, 1, 1]]])
    who = [*range(500, 510), 509]
    rows = vec.nearest(table(spark, q, who), table(spark, r, ids), "vec_id", k=30, block=16).collect()
    assert len(rows) == 10
    for row in rows:
        every = sorted((float(d), int(j)) for i, x in zip(who, q, strict=True) if i == row.vec_id for d, j in zip(np.sqrt(((r - x) ** 2).sum(axis=1)), ids, strict=True))
        assert [(n["d"], n["id"]) for n in row.top] == every[:30]


def test_groups_of_cells():
    first, parts = vec._grouped(np.array([3, 25, 4, 2, 9]), np.array([0, 2, 1, 3, 4]), 10)
    assert first.tolist() == [0, 1, 0, 4, 5] and parts.tolist() == [1, 3, 1, 1, 1]
