import math

import pytest
from pyspark.sql import functions as F

from scoreloom.functions import levels as lv
from scoreloom.functions.numerics import dbl, erf


def one(spark, *cols):
    return spark.range(1).select(*cols).first()


def arr(*v):
    return lv.constants(v)


def test_erf_matches_library(spark):
    rows = spark.range(-300, 301).select((F.col("id") / 50.0).alias("x")).select("x", erf(F.col("x")).alias("e")).collect()
    assert max(abs(r.e - math.erf(r.x)) for r in rows) < 1e-14


def test_divergences(spark):
    p, q = arr(0.1, 0.3, 0.4, 0.15, 0.05), arr(1, 0, 0, 0, 0)
    far = arr(0, 0, 0, 0, 1)
    r = one(spark, lv.jsd(p, p).alias("same"), lv.jsd(q, far).alias("far"), lv.jsd(p, q).alias("a"), lv.jsd(q, p).alias("b"),
            lv.entropy(arr(.2, .2, .2, .2, .2)).alias("h"), lv.entropy(q).alias("h0"), lv.kl(p, q).alias("inf"), lv.kl(p, p).alias("kl0"))
    assert r.same == pytest.approx(0, abs=1e-12) and r.far == pytest.approx(math.log(2), abs=1e-9)
    assert r.a == pytest.approx(r.b) and r.h == pytest.approx(math.log(5)) and r.h0 == pytest.approx(0)
    assert r.inf == math.inf and r.kl0 == pytest.approx(0)


def test_gaussian_and_two_level(spark):
    r = one(spark, lv.gaussian_levels(dbl(3), dbl(0.8)).alias("g"), lv.two_level(dbl(3.25)).alias("t"), lv.prediction_levels(dbl(4), dbl(0.0)).alias("sharp"),
            lv.gaussian_bins(dbl(2.2), dbl(0.3)).alias("bins"), lv.mos(lv.two_level(dbl(3.25))).alias("m"), lv.two_level(dbl(9)).alias("top"))
    assert sum(r.g) == pytest.approx(1) and r.g[2] == max(r.g) and r.g[1] == pytest.approx(r.g[3])
    assert r.t == pytest.approx([0, 0.25, 0.75, 0, 0]) and r.m == pytest.approx(3.25)
    assert r.sharp == pytest.approx([0, 1, 0, 0, 0]) and sum(r.bins) == pytest.approx(1) and r.top[0] == 1


def test_gaussian_levels_against_direct_integration(spark):
    cdf = lambda z: 0.5 * (1 + math.erf(z / math.sqrt(2)))
    mu, s = 2.7, 0.55
    mass = [cdf((v + 0.5 - mu) / s) - cdf((v - 0.5 - mu) / s) for v in (5, 4, 3, 2, 1)]
    got = one(spark, lv.gaussian_levels(dbl(mu), dbl(s)).alias("p")).p
    assert got == pytest.approx([m / sum(mass) for m in mass], abs=1e-12)


def test_bald_and_validation(spark):
    a, b = arr(1, 0, 0, 0, 0), arr(0, 0, 0, 0, 1)
    r = one(spark, lv.bald(F.array(a, a)).alias("agree"), lv.bald(F.array(a, b)).alias("differ"), lv.bald(F.array(a)).alias("single"),
            lv.problem(arr(1, 2)).alias("short"), lv.problem(arr(-1, 1, 1, 0, 0)).alias("neg"), lv.problem(arr(0, 0, 0, 0, 0)).alias("zero"), lv.checked(arr(2, 2, 0, 0, 0)).alias("ok"))
    assert r.agree == 0 and r.differ == pytest.approx(math.log(2)) and r.single == 0
    assert (r.short, r.neg, r.zero) == ("length", "negative", "no mass") and r.ok == [0.5, 0.5, 0, 0, 0]
    with pytest.raises(Exception):
        spark.range(1).select(lv.checked(F.array(F.col("id").cast("double")))).collect()


def test_linear_fix_keeps_mass_and_mean(spark):
    p = arr(0.1, 0.3, 0.3, 0.2, 0.05)
    r = one(spark, lv.linear_fix(p, dbl(3.4)).alias("f"))
    fixed = [v * r.f.alpha + r.f.beta for v in (0.1, 0.3, 0.3, 0.2, 0.05)]
    assert sum(fixed) == pytest.approx(1) and sum(v * w for v, w in zip(fixed, (5, 4, 3, 2, 1))) == pytest.approx(3.4, abs=1e-6)
