"""Findings of round 4: what the mended queries return, by plain counting."""

import hashlib

from pyspark.sql import functions as F

import __spark_entry__ as entry
from scoreloom.functions import bins, levels as lv
from scoreloom.operators import assembly as asm, bootstrap as bs
from scoreloom.plans.tables import Tables

SF = "/root/testdata/sf0.001"


def drawn(effect, seed):
    return int(hashlib.md5(f"{effect}:{seed}".encode()).hexdigest()[:15], 16) % 1_000_000 / 1e6


def test_degradation_plan_has_severities(spark):
    rows = entry.queries()["x14_degradation_plan"](spark, SF).collect()
    images = {r.image_id for r in rows}
    assert len(rows) == 4 * len(images)
    for r in rows[:200]:
        _, name, lo, hi = next(t for t in asm.DEGRADATIONS if t[0] == r.tier)
        worst = [1 - hi + drawn(e, r.seed) * (hi - lo) for e in ("blur", "noise", "compression", "geometric_distortion")]
        assert r.profile == name and all(abs(a - b) < 1e-8 for a, b in zip(worst, (r.blur, r.noise, r.compression, r.geometric_distortion), strict=True))
        assert abs(r.overall_quality - max(0.0, 1 - max(worst))) < 1e-8 and lo - 1e-8 <= r.overall_quality <= hi + 1e-8


def joins(df):
    return df._jdf.queryExecution().optimizedPlan().toString().count("Join ")


def test_starting_tables_meet_before_there_is_a_row_per_dimension(spark):
    t = Tables(spark, SF)
    assert joins(t.paired) == 1 and joins(t.scored) == 2
    for df, each in ((t.paired, ["image_id", "dimension"]), (t.scored, ["image_id", "dimension", "model"])):
        plan = df._jdf.queryExecution().optimizedPlan().toString().splitlines()
        assert min(i for i, line in enumerate(plan) if "Generate" in line) < min(i for i, line in enumerate(plan) if "Join " in line)
        assert df.count() == df.select(*each).distinct().count() > 0
    by_hand = t.panel.join(t.truth.select("image_id", "dimension", "gt", "category", "split"), ["image_id", "dimension"])
    assert sorted(map(tuple, t.scored.collect())) == sorted(map(tuple, by_hand.select(*t.scored.columns).collect()))
    by_hand = t.preds.join(t.truth, ["image_id", "dimension"])
    assert sorted(map(tuple, t.paired.collect())) == sorted(map(tuple, by_hand.select(*t.paired.columns).collect()))


def test_draws_without_errors_need_a_third_of_the_memory(spark, monkeypatch):
    """Groups of up to three times the rows stay in tasks; none takes the way whose disk grows with rows times draws."""
    df = spark.createDataFrame([(i, d, a, float(i * 7 % 31), float(i * 5 % 29)) for i in range(40) for d in ("overall", "sharpness", "color") for a in ("base", "other")],
                               "image_id long, dimension string, arm string, pred double, gt double")
    want = bs.paired_deltas(df, "base", 120, 1).first()
    monkeypatch.setattr(bs, "ROWS_AT_ONCE", 100)  # of 240
    monkeypatch.setattr(bs, "draws", None)
    assert bs.paired_deltas(df, "base", 120, 1).first() == want


def test_bins_of_batches_equal_the_expressions(spark):
    scores = [None, float("nan"), -3.0, 0.999, 1.0, 1.2, 2.71828, 3.4, 4.999, 5.0, 9.0, *[1 + i / 97 for i in range(380)]]
    df = spark.createDataFrame([(s,) for s in scores], "score double").repartition(2)
    rows = df.select(bins.gaussian_bins(0.25)(F.col("score")).alias("a"), lv.gaussian_bins(F.col("score"), F.lit(0.25)).alias("b")).collect()
    assert len(rows) == len(scores) and all(abs(x - y) < 1e-14 for r in rows for x, y in zip(r.a, r.b, strict=True))
    odd = [[0.0] * 10, [None] + [0.1] * 9, [float(i) for i in range(10)], [-1.0] * 10, [float("nan")] + [1.0] * 9]
    rows = spark.createDataFrame([(o,) for o in odd], "v array<double>").select(bins.bins_to_levels("v").alias("a"), lv.bins_to_levels(F.col("v")).alias("b")).collect()
    assert all(x == y or abs(x - y) < 1e-14 or (x != x and y != y) for r in rows for x, y in zip(r.a, r.b, strict=True))


def test_bin_records_are_read_once(spark):
    plan = entry.queries()["d18_bin_records"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json(") == 2  # one for each kind of rater
    assert "ArrowEvalPython" in plan and "exp(" not in plan.lower()
