"""Draws that tasks work out for themselves: the same scores, and nothing of rows times draws written."""

import math
from pathlib import Path

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from scoreloom.functions.hashing import picks
from scoreloom.functions.numerics import key_hash
from scoreloom.operators import bootstrap as bs
from scoreloom.operators.staging import shared_folder


def test_picks_are_the_key_hash(spark):
    for seed, n in ((42, 1), (7, 12), ("seed", 1234)):
        want = spark.range(n).select(*[(key_hash(seed, F.lit(r), F.col("id")) % n).alias(f"r{r}") for r in (0, 9, 1000)]).collect()
        assert picks(seed, [0, 9, 1000], n).T.tolist() == [list(r) for r in want]


def table(spark):
    rng = np.random.default_rng(4)
    pdf = pd.DataFrame({"k": np.tile(np.arange(60), 4), "g": np.repeat(["p", "q"], 120), "d": np.tile(np.repeat(["a", "b"], 60), 2),
                        "x": np.round(rng.uniform(1, 5, 240), 1), "y": np.round(rng.uniform(1, 5, 240), 1)})
    return spark.createDataFrame(pdf[(pdf.g == "p") | (pdf.k < 41)])


@pytest.mark.parametrize("most", [None, 100])  # 82 rows of q fit, 120 of p don't
def test_resampled_equals_draws_and_scores(spark, monkeypatch, most):
    df = table(spark)
    if most:
        monkeypatch.setattr(bs, "ROWS_AT_ONCE", most)
    times = bs.draws(df.select("g", "k"), "k", 40, 3, ["g"]).drop("n")
    keys = ["g", "d", "rep"]
    want = {tuple(r[c] for c in keys): r for r in bs.scores(df.join(times, ["g", "k"]), ["g", "d"], "x", "y", 41, 3.0).collect()}
    got = {tuple(r[c] for c in keys): r for r in bs.resampled(df, "k", ["g"], ["d"], "x", "y", 40, 3, errors=True, good=3.0).collect()}
    assert set(got) == set(want) and len(got) == 4 * 41
    for key, row in got.items():
        assert row.units == (60 if key[0] == "p" else 41)
        assert all(row[c] == pytest.approx(want[key][c], abs=1e-9) for c in ("n", *bs.SCORES))
    assert {r.g for r in bs.resampled(df, "k", ["g"], ["d"], "x", "y", 2, 3, min_units=50).collect()} == {"p"}


def test_no_row_of_every_draw_is_written(spark):
    rng = np.random.default_rng(5)
    rows = [(i, d, arm, float(rng.uniform(1, 5)), float(rng.uniform(1, 5))) for i in range(300) for d in ("overall", "sharpness", "color") for arm in ("base", "other")]
    df = spark.createDataFrame(rows, "image_id long, dimension string, arm string, pred double, gt double")
    folder = Path(shared_folder(spark))
    size = lambda: sum(f.stat().st_size for f in folder.rglob("*") if f.is_file())
    before = size()
    assert bs.paired_deltas(df, "base", 1000, 1).count() == 1
    assert size() - before < 1_000_000  # a rank per row, side and draw is 14 MB


def test_early_hashes_hold_every_subsample(spark, monkeypatch):
    units = spark.createDataFrame([(i, 0 if i < 700 else 1 if i < 799 else 2) for i in range(800)], "image_id long, bucket int")
    got = lambda: sorted(map(tuple, bs.subsamples(units, "bucket", "image_id", [10, 50], 6, 3).collect()))
    usual = got()
    monkeypatch.setattr(bs, "SPARE", -math.sqrt(51) / 2)  # too few rows: these draws take the long way
    assert got() == usual
