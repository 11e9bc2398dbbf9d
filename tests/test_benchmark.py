"""The wide benchmark table on hand-made replies."""

import pytest
from pyspark.sql import functions as F

from scoreloom.operators import benchmark, uncertainty


def test_few_pairs_give_counts_only(spark):
    log = [("many", i, "" if i else "api error", 10.0 * i) for i in range(41)] + [("few", i, None, 5.0) for i in range(3)] + [("none", 0, "api error", 7.0)]
    pairs = [(m, i, d, float(i % 7), float(i % 7 if d == "overall" else -(i % 7))) for m, i, e, _ in log if not e for d in ("overall", "color")]
    rows = benchmark.table(spark.createDataFrame(pairs, "model_id string, image_id long, dimension string, pred double, truth double"),
                           spark.createDataFrame(log, "model_id string, image_id long, error string, latency_ms double"), {"notes": F.lit("x")}, 50, 1)
    got = {r.model_id: r for r in rows.collect()}
    assert set(got) == {"many", "few", "none"} and all(r.notes == "x" for r in got.values())
    many = got["many"]
    assert many.num_samples == 40 and many.success_rate == pytest.approx(40 / 41)
    assert many.overall_srcc == pytest.approx(1) and many.color_plcc == pytest.approx(-1) and many.sharpness_srcc is None
    assert many.overall_plcc_ci_lower == pytest.approx(1) and many.overall_rmse == 0 and many.wsrcc == pytest.approx(0.25)
    assert many.inference_mean_ms == pytest.approx(205) and many.inference_p50_ms == pytest.approx(205) and many.inference_p95_ms == pytest.approx(380.5)
    assert got["few"].num_samples == 3 and got["few"].overall_srcc is None and got["few"].wsrcc is None and got["few"].success_rate == 1
    assert got["none"].num_samples == 0 and got["none"].success_rate == 0 and got["none"].inference_mean_ms is None


def test_iteration_log(spark):
    agreement = spark.createDataFrame([(5, 0.8, 0.7), (6, 0.805, 0.9), (8, None, 0.9)], "step int, srcc double, plcc double")
    scored = spark.createDataFrame([(5, 0.2), (5, 0.0), (6, 0.1), (7, 0.9)], "step int, bald double")
    rows = sorted(tuple(r) for r in uncertainty.iteration_log(agreement, scored, "step", 0.1).drop("srcc_delta", "plcc_delta").collect())
    assert rows == [(5, 1, 0.1, 1, False), (6, 2, 0.1, 0, True), (8, 3, 0.0, 0, False)]
    assert uncertainty.iteration_log(agreement.limit(0), scored, "step", 0.1).count() == 0
