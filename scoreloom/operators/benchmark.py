"""Benchmark table: one wide row per judged model."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from . import bootstrap as bs
from .agreement import DIMENSION_WEIGHTS
from .staging import staged

INTERVALS = ("plcc", "srcc")
ERRORS = ("mae", "rmse")
MIN_PAIRS = 30  # fewer graded replies give no metrics
LATENCIES = ("inference_mean_ms", "inference_p50_ms", "inference_p95_ms")


def replies(log: DataFrame) -> DataFrame:
    """model_id, success_rate and latencies of the rows of ``log`` (model_id, error, latency_ms);
    a null or empty error is a success, and only successes have a latency. Percentiles interpolate."""
    good = F.coalesce("error", F.lit("")) == ""
    ms = F.when(good, F.col("latency_ms"))
    return log.groupBy("model_id").agg(F.avg(good.cast("double")).alias("success_rate"), F.avg(ms).alias("inference_mean_ms"), F.percentile(ms, [0.5, 0.95]).alias("_p")).select(
        "model_id", "success_rate", "inference_mean_ms", F.col("_p")[0].alias("inference_p50_ms"), F.col("_p")[1].alias("inference_p95_ms"))


def metric_columns(dimension: str) -> list[str]:
    ends = [c for m in INTERVALS for c in (m, f"{m}_ci_lower", f"{m}_ci_upper")]
    return [f"{dimension}_{c}" for c in (*ends, *ERRORS)]


def table(pairs: DataFrame, log: DataFrame, about: dict[str, Column], repeats: int, seed, dimensions=tuple(DIMENSION_WEIGHTS)) -> DataFrame:
    """One row per model of ``log``: what ``about`` says of it, success, metrics with intervals, wSRCC, latency.

    ``pairs`` has model_id, image_id, dimension, pred and truth of graded replies. Images are drawn per
    model, with all their dimensions. A model with fewer than MIN_PAIRS graded images has its
    count and rates only; one without any has a count of 0.
    """
    pairs = staged(pairs.where("pred is not null and truth is not null").select("model_id", "image_id", "dimension", "pred", "truth"), "graded")
    count = pairs.groupBy("model_id").agg(F.countDistinct("image_id").alias("num_samples"))
    values = staged(bs.resampled(pairs, "image_id", ["model_id"], ["dimension"], "pred", "truth", repeats, seed, errors=True, min_units=MIN_PAIRS), "scores")

    point = values.where("rep = 0").select("model_id", "dimension", *INTERVALS, *ERRORS)
    for m in INTERVALS:  # a fixed number of draws per model and dimension from here on
        ends = bs.interval(values.where("rep > 0"), m, ["model_id", "dimension"])
        point = point.join(ends.select("model_id", "dimension", F.col("ci_low").alias(f"{m}_ci_lower"), F.col("ci_high").alias(f"{m}_ci_upper")), ["model_id", "dimension"], "left")
    weight = sum((F.coalesce(F.max(F.when(F.col("dimension") == d, F.col("srcc"))), F.lit(0.0)) * w for d, w in DIMENSION_WEIGHTS.items()), F.lit(0.0))
    point = staged(point, "points")
    wide = point.groupBy("model_id").pivot("dimension", list(dimensions)).agg(*[F.first(c).alias(c) for c in point.columns[2:]])
    total = point.groupBy("model_id").agg(weight.alias("wsrcc"))
    rows = replies(log).join(count, "model_id", "left").join(wide, "model_id", "left").join(total, "model_id", "left")
    return rows.select("model_id", *[c.alias(n) for n, c in about.items()], F.coalesce("num_samples", F.lit(0)).alias("num_samples"), "success_rate",
                       *[c for d in dimensions for c in metric_columns(d)], "wsrcc", *LATENCIES)
