"""Draws and the statistics of draws against plain numpy on materialised resamples."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from scoreloom.operators import bootstrap as bs, records, slices


def times_of(row):
    return np.frombuffer(row.times, np.uint16)


def test_draws_are_complete_and_repeatable(spark):
    df = spark.range(50).select((F.col("id") * 7).alias("k"), F.expr("if(id < 20, 'a', 'b')").alias("g"))
    got = {(r.g, r.k): times_of(r) for r in bs.draws(df, "k", 20, 42, ["g"]).collect()}
    assert len(got) == 50 and all(t[0] == 1 for t in got.values())
    for g, n in (("a", 20), ("b", 30)):
        assert (sum(t for (h, _), t in got.items() if h == g) == n).all()
    again = {(r.g, r.k): times_of(r) for r in bs.draws(df.repartition(3).unionAll(df), "k", 20, 42, ["g"]).collect()}
    assert all((again[k] == t).all() for k, t in got.items())


def ranks(v):
    return pd.Series(v).rank().to_numpy()


@pytest.mark.parametrize("most", [None, 9])
def test_scores_equal_materialised_resamples(spark, monkeypatch, most):
    if most:  # slices of few rows: groups cross them
        monkeypatch.setattr(bs, "VECTOR_BYTES", 2 * 26 * most)
        monkeypatch.setattr(bs, "TOGETHER", 7)
    rng = np.random.default_rng(2)
    pdf = pd.DataFrame({"k": np.tile(np.arange(45), 2), "g": np.repeat(["p", "q"], 45), "x": np.round(rng.uniform(1, 5, 90), 1), "y": np.round(rng.uniform(1, 5, 90), 1)})
    pdf.loc[pdf.g == "q", "x"] = 2.0  # no spread
    pdf.loc[60:, "x"] = 3.0
    df = spark.createDataFrame(pdf)
    units = bs.draws(df.select("k"), "k", 25, 5)
    times = {r.k: times_of(r) for r in units.collect()}
    got = {(r.g, r.rep): r for r in bs.scores(df.join(units.drop("n"), "k"), ["g"], "x", "y", 26, good=3.0).collect()}
    assert len(got) == 52
    for g, part in pdf.groupby("g"):
        for rep in range(26):
            rows = part.loc[part.index.repeat([times[k][rep] for k in part["k"]])]
            x, y, r = rows["x"].to_numpy(), rows["y"].to_numpy(), got[g, rep]
            assert r.n == len(x) and r.mae == pytest.approx(np.abs(x - y).mean()) and r.rmse == pytest.approx(np.sqrt(((x - y) ** 2).mean()))
            assert r.srcc == pytest.approx(np.corrcoef(ranks(x), ranks(y))[0, 1], abs=1e-9) and r.plcc == pytest.approx(np.corrcoef(x, y)[0, 1], abs=1e-9)
            pos, neg = x[y >= 3], x[y < 3]
            assert r.auroc == pytest.approx((pos[:, None] > neg).mean() + (pos[:, None] == neg).mean() / 2, abs=1e-9)


def test_flat_and_short_groups_have_no_coefficient(spark):
    df = spark.createDataFrame([("flat", i, 1.0, float(i)) for i in range(5)] + [("short", i, float(i), float(i)) for i in range(2)], "g string, k long, x double, y double")
    units = bs.draws(df.select("g", "k"), "k", 3, 1, ["g"]).drop("n")
    rows = bs.scores(df.join(units, ["g", "k"]), ["g"], "x", "y", 4).where("rep = 0").collect()
    assert all(r.srcc is None and r.plcc is None for r in rows) and len(rows) == 2


def test_subsamples_follow_the_strata(spark):
    units = spark.createDataFrame([(i, 0 if i < 60 else 1 if i < 99 else 2) for i in range(100)], "image_id long, bucket int")
    got = bs.subsamples(units, "bucket", "image_id", [10, 50, 100, 500], 6, 3).toPandas()
    assert sorted(got["rep"].unique()) == list(range(18))  # 500 is more than there are
    for rep, part in got.groupby("rep"):
        n = [10, 50, 100][rep // 6]
        assert len(part) == n and part["image_id"].is_unique
        if n == 50:  # 30, 20 (19.5 to even) and 1, less one
            counts = part["image_id"].map(lambda i: 0 if i < 60 else 1 if i < 99 else 2).value_counts()
            assert 29 <= counts[0] <= 30 and 19 <= counts[1] <= 20


def test_better_arms_win(spark):
    rng = np.random.default_rng(1)
    rows = []
    for i in range(160):
        for d in ("overall", "sharpness", "color"):
            gt = float(rng.uniform(1, 5))
            rows += [(i, d, arm, gt + float(rng.normal(0, noise)), gt) for arm, noise in (("base", 1.0), ("near", 0.2), ("far", 3.0)) if arm != "far" or i < 150]
    df = spark.createDataFrame(rows + [(999, "overall", "tiny", 1.0, 1.0)], "image_id long, dimension string, arm string, pred double, gt double")
    got = {r.arm: r for r in bs.paired_deltas(df, "base", 200, 42).collect()}
    assert set(got) == {"near", "far"} and (got["near"].n_common, got["far"].n_common) == (160, 150)
    assert got["near"].ci_low > 0 and got["near"].p_positive == 1 and got["far"].ci_high < 0 and got["near"].draws == 200
    assert got["near"].ci_low < got["near"].delta < got["near"].ci_high and got["near"].delta == pytest.approx(got["near"].arm_wsrcc - got["near"].baseline_wsrcc)
    curve = {(r.n, r.arm): r for r in bs.power_curve(df, records.quality_bucket, [25, 100, 1000], 40, 42).collect()}
    assert set(curve) == {(n, a) for n in (25, 100) for a in ("base", "near", "far")}
    assert curve[25, "base"].sd > curve[100, "base"].sd and curve[100, "near"].win_share == 1
    assert bs.power_curve(df, records.quality_bucket, [25], 4, 42, min_images=1000).count() == 0
