"""Rank coefficients and configurations carry what they need, and no more."""

from pathlib import Path

import numpy as np
import pandas as pd
import pyarrow.parquet as pq
import pytest

from scoreloom.operators import agreement as ag, ensemble as en
from scoreloom.operators.staging import shared_folder


def written(spark, work):
    folder = Path(shared_folder(spark))
    before = set(folder.iterdir()) if folder.exists() else set()
    out = work()
    return out, [set(pq.read_schema(next(d.glob("*.parquet"))).names) for d in folder.iterdir() if d not in before and any(d.glob("*.parquet"))]


def test_spearman_writes_codes_not_names(spark):
    rng = np.random.default_rng(6)
    pdf = pd.DataFrame({"name": np.repeat(["long name of one", "long name of two", None], 40), "x": rng.integers(0, 9, 120).astype(float), "y": rng.uniform(size=120)})
    pdf.loc[3, "y"] = np.inf
    rows, kinds = written(spark, lambda: ag.spearman(spark.createDataFrame(pdf), "x", "y", ["name"]).collect())
    assert kinds and not any("name" in k for k in kinds)
    for name, part in pdf[np.isfinite(pdf.y)].fillna({"name": ""}).groupby("name"):
        row = next(r for r in rows if (r.name or "") == name)
        assert row.n == len(part) and row.srcc == pytest.approx(np.corrcoef(part.x.rank(), part.y.rank())[0, 1])


def test_every_configuration_is_made_inside_an_image(spark):
    scores = spark.createDataFrame([(i, "overall", m, float(i + j), 1.0 * i) for i in range(4) for j, m in enumerate("abcd") if (i, m) != (3, "d")], "image_id long, dimension string, model string, score double, gt double")
    members = [("all median", "median", m, 1.0, 4) for m in "abcd"] + [("three", "median", m, 1.0, 3) for m in "abc"] + [("pair", "mean", m, 1.0, 2) for m in "ad"] + [("heavy", "weighted", "a", 1.0, 2), ("heavy", "weighted", "b", 3.0, 2)]
    out = en.combine(scores, spark.createDataFrame(members, "config string, method string, model string, weight double, size int"))
    got = {(r.config, r.image_id): r.score for r in out.collect()}
    assert {i for c, i in got if c == "all median"} == {0, 1, 2} and {i for c, i in got if c == "heavy"} == {0, 1, 2, 3}
    assert (got["all median", 1], got["three", 3], got["pair", 2], got["heavy", 0]) == (2.5, 4.0, 3.5, 0.75)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "median(" not in plan.lower()  # no aggregate over rows times configurations


def test_weighting_schemes_rank_keys_and_signals_alone(spark):
    from __spark_entry__ import queries

    rows, kinds = written(spark, lambda: queries()["u17_weighting_schemes"](spark, "/root/testdata/sf0.001").collect())
    ranked = [k for k in kinds if "entropy" in k]
    assert rows and ranked and not any(k & {"probs", "cross_probs", "category", "mos", "spread"} for k in ranked)
