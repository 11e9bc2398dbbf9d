import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from scoreloom.operators import agreement as ag, bootstrap as bs, uncertainty as un
from scoreloom.operators.ranking import average_rank, position, quantiles, unit_ranks


@pytest.fixture(scope="module")
def skewed(spark):
    """One group holds most rows and one value a third of them."""
    rng = np.random.default_rng(3)
    n = 6000
    pdf = pd.DataFrame({"k": rng.permutation(n), "g": np.where(rng.random(n) < 0.7, "hot", "cold"), "v": np.where(rng.random(n) < 0.34, 1.5, np.round(rng.normal(size=n), 2)),
                        "w": np.round(rng.normal(size=n), 1)})
    pdf.loc[0, "g"] = "lonely"
    return pdf, spark.createDataFrame(pdf).repartition(7).cache()


def test_average_rank(skewed):
    pdf, df = skewed
    got = average_rank(df, "v", ["g"]).toPandas().set_index("k")["rank"].sort_index()
    assert np.allclose(got, pdf.set_index("k").groupby("g")["v"].rank().sort_index())
    whole = average_rank(df, "v").toPandas().set_index("k")["rank"].sort_index()
    assert np.allclose(whole, pdf.set_index("k")["v"].rank().sort_index())


@pytest.mark.parametrize("descending", [False, True])
def test_position_breaks_ties_by_key(skewed, descending):
    pdf, df = skewed
    got = position(df, "v", "k", ["g"], descending=descending, size="n").toPandas().set_index("k").sort_index()
    want = pdf.sort_values(["v", "k"], ascending=[not descending, True])
    want["pos"] = want.groupby("g").cumcount() + 1
    assert (got["pos"] == want.set_index("k")["pos"].sort_index()).all()
    assert (got["n"] == pdf.set_index("k").groupby("g")["v"].transform("size").sort_index()).all()


def test_quantiles_match_numpy(skewed):
    pdf, df = skewed
    got = quantiles(df, "v", {"a": 0.1, "b": 0.5, "c": 0.973}, ["g"]).toPandas().set_index("g")
    for g, part in pdf.groupby("g"):
        assert np.allclose(got.loc[g, ["a", "b", "c"]].astype(float), np.percentile(part["v"], [10, 50, 97.3]))


def test_unit_ranks_of_a_single_row(skewed):
    _, df = skewed
    rows = unit_ranks(df, {"v": "a", "w": "b"}, ["g"]).where("g = 'lonely'").collect()
    assert [(r.a, r.b) for r in rows] == [(0.0, 0.0)]


def test_spearman_and_auroc(skewed):
    pdf, df = skewed
    got = {r.g: r.srcc for r in ag.spearman(df, "v", "w", ["g"]).collect()}
    for g in ("hot", "cold"):
        part = pdf[pdf.g == g]
        assert got[g] == pytest.approx(part["v"].rank().corr(part["w"].rank()), abs=1e-9)
    assert got["lonely"] is None
    lab = pdf.assign(y=(pdf.w > 0.3).astype(int))
    auc = ag.auroc(df.withColumn("y", (F.col("w") > 0.3).cast("int")), "v", "y").first()
    pos, neg = lab[lab.y == 1].v.to_numpy(), lab[lab.y == 0].v.to_numpy()
    brute = ((pos[:, None] > neg).mean() + 0.5 * (pos[:, None] == neg).mean())
    assert auc.auroc == pytest.approx(brute, abs=1e-9)


def test_guarded_coefficients(spark):
    df = spark.createDataFrame([("c", 1.0, float(i)) for i in range(5)] + [("m", float(i), 2.0 * i) for i in range(5)] + [("s", 1.0, 2.0)], "g string, x double, y double")
    got = {r.g: r.p for r in df.groupBy("g").agg(ag.guarded_corr("x", "y", 0.0).alias("p")).collect()}
    assert got["c"] == 0.0 and got["m"] == pytest.approx(1) and got["s"] == 0.0


def test_rank_tests_p_values(spark):
    rows = [("a", i, float(i % 17) + (2.0 if i % 2 else 0.0), i % 2) for i in range(200)]
    df = spark.createDataFrame(rows, "g string, i int, v double, half int")
    p = ag.mann_whitney(df, "v", F.col("half") == 0, ["g"]).first()
    assert 0 <= p.p_value < 0.05 and p.n_in == 100
    w = ag.wilcoxon_greater(df.withColumn("d", F.col("v") - 5), "d", ["g"]).first()
    assert w.p_value < 0.001
    r = ag.correlation_p(spark.createDataFrame([(0.5, 20), (0.0, 20), (1.0, 5)], "r double, n bigint"), "r").collect()
    assert r[0].p_value == pytest.approx(0.02482, abs=1e-4) and r[1].p_value == pytest.approx(1) and r[2].p_value == 0


def test_rank_tests_exact_p(spark):
    """Hand-counted tails: 7 of 126 and 5 of 64."""
    rows = [("lo", v) for v in (1.0, 2.0, 4.0, 6.0)] + [("hi", v) for v in (3.0, 5.0, 7.0, 8.0, 9.0)]
    m = ag.mann_whitney(spark.createDataFrame(rows, "side string, v double"), "v", F.col("side") == "lo").first()
    assert m.u == 3 and m.p_value == pytest.approx(7 / 126)
    d = spark.createDataFrame([("g", v) for v in (1.0, 2.0, -3.0, 4.0, 5.0, 6.5)] + [("few", 1.0)], "g string, d double")
    w = {r.g: r for r in ag.wilcoxon_greater(d, "d", ["g"]).collect()}
    assert w["g"].p_value == pytest.approx(5 / 64)
    assert w["few"].n == 1 and w["few"].p_value is None and w["few"].statistic is None


def test_holm_is_a_plain_step_down(spark):
    df = spark.createDataFrame([("a", 0.01), ("b", 0.04), ("c", 0.9)], "arm string, p_value double")
    assert {r.arm: round(r.p_holm, 6) for r in bs.holm(df).collect()} == {"a": 0.03, "b": 0.08, "c": 0.9}


def row(**kw):
    base = dict(image_id=1, dimension="overall", distance=30.0, jsd=0.03, sigma_sq=0.3, entropy=0.8, spread=0.0, n_spread_models=0)
    return {**base, **kw}


def test_tier_branches(spark):
    cases = [(row(), "auto_accept"), (row(distance=70.0), "hard_reject"), (row(distance=58.0), "tier2_trigger"), (row(jsd=0.09), "low_weight"), (row(jsd=0.2), "tier2_trigger"),
             (row(sigma_sq=0.8), "low_weight"), (row(entropy=1.6), "tier2_trigger"), (row(spread=9.0, n_spread_models=1), "auto_accept")]
    df = spark.createDataFrame([{**c, "want": w} for c, w in cases])
    for r in un.decide(df, un.Thresholds(spread_auto=0.3, spread_low=0.5)).collect():
        assert r.tier == r.want and (r.weight == 1.0) == (r.tier == "auto_accept") and (0.3 <= r.weight <= 0.6 if r.tier == "low_weight" else True)
    wide = spark.createDataFrame([row(spread=0.4, n_spread_models=3), row(spread=0.9, n_spread_models=3)])
    assert [r.tier for r in un.decide(wide, un.Thresholds(spread_auto=0.3, spread_low=0.5)).collect()] == ["low_weight", "tier2_trigger"]


def test_normaliser_refuses_constant_and_short_raters(spark):
    short = spark.createDataFrame([("m", float(i)) for i in range(5)], "model string, score double")
    flat = spark.createDataFrame([("m", 1.0)] * 20, "model string, score double")
    for df in (short, flat):
        with pytest.raises(Exception):
            un.fit_normaliser(df).collect()


def test_many_slices_equal_one(spark, monkeypatch):
    """Groups and runs of ties that cross slices, slices of one row, groups of one row."""
    from scoreloom.operators import slices

    rng = np.random.default_rng(9)
    n = 400
    pdf = pd.DataFrame({"k": np.arange(n), "g": rng.choice(["hot", "hot", "hot", "b", "c", None], n), "h": rng.integers(0, 2, n),
                        "v": np.where(rng.random(n) < 0.5, 2.0, np.round(rng.normal(size=n), 1)), "w": rng.integers(1, 5, n)})
    df = spark.createDataFrame(pdf.astype(object).where(pdf.notna(), None), "k long, g string, h long, v double, w long")
    grouped = pdf.fillna({"g": "none"})
    for most in (1, 7, 60):
        monkeypatch.setattr(slices, "MOST", most)
        for by in (["g"], ["g", "h"], []):
            got = slices.placed(df, by, ["v"], "w").toPandas().set_index("k").sort_index()
            for _, part in grouped.groupby(by) if by else [(0, grouped)]:
                v, w = part["v"].to_numpy(), part["w"].to_numpy()
                mine = got.loc[part["k"]]
                assert (mine["_before"].to_numpy() == [w[v < x].sum() for x in v]).all()
                assert (mine["_run"].to_numpy() == [w[v == x].sum() for x in v]).all()
                assert (mine["_size"] == w.sum()).all()
        pos = position(df, "v", "k", ["g"], size="n").toPandas().set_index("k")["pos"].sort_index()
        want = grouped.sort_values(["v", "k"]).groupby("g").cumcount().sort_index() + 1
        assert (pos == want).all()
    assert slices.placed(df.where("false"), ["g"], ["v"]).count() == 0
