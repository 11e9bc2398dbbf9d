"""Queries without comparison SQL cover all groups and sizes."""

import numpy as np

import __spark_entry__ as entry
from scoreloom.operators import isotonic

SF = "/root/testdata/sf0.01"


def pooled(rows):
    """Increasing fit by hand: value per distinct x."""
    blocks = []
    for x in sorted({a for a, _ in rows}):
        ys = [b for a, b in rows if a == x]
        blocks.append([sum(ys), len(ys), [x]])
        while len(blocks) > 1 and blocks[-2][0] / blocks[-2][1] >= blocks[-1][0] / blocks[-1][1]:
            s, n, xs = blocks.pop()
            blocks[-1] = [blocks[-1][0] + s, blocks[-1][1] + n, blocks[-1][2] + xs]
    return {x: s / n for s, n, xs in blocks for x in xs}


def test_isotonic_by_group(spark):
    rng = np.random.default_rng(3)
    rows = [(m, d, float(rng.integers(1, 30)) / 6, float(rng.uniform(1, 5))) for m in "abc" for d in ("x", "y") for _ in range(60)]
    df = spark.createDataFrame([*rows, ("a", "x", None, 2.0)], "model string, dimension string, score double, gt double")
    got = isotonic.fitted(df, ["model", "dimension"]).collect()
    assert len(got) == len(rows) + 1
    for m in "abc":
        for d in ("x", "y"):
            fit = pooled([(s, g) for a, b, s, g in rows if (a, b) == (m, d)])
            assert all(abs(r.calibrated - fit[r.score]) < 1e-9 for r in got if (r.model, r.dimension) == (m, d) and r.score is not None)


def test_isotonic_query_has_all_groups(spark):
    got = entry.queries()["m3_isotonic_fit"](spark, SF).select("model", "dimension").distinct().collect()
    assert len({r.model for r in got}) > 1 and len({r.dimension for r in got}) > 1
