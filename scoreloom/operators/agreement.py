"""Agreement statistics over grouped tables."""

from __future__ import annotations

from collections.abc import Sequence

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.exact import exact_mann_whitney, exact_signed_rank
from ..functions.numerics import dbl, safe_ratio
from .ranking import attach, average_rank, cumulative, position, quantiles
from .slices import group_code, placed
from .staging import staged

DIMENSION_WEIGHTS = {"overall": 0.5, "sharpness": 0.25, "color": 0.25}


def guarded_corr(x, y, small=None) -> Column:
    """Pearson coefficient as an aggregate; ``small`` where it is undefined."""
    small = F.lit(small).cast("double")
    n = F.count(F.when(F.col(x).isNotNull() & F.col(y).isNotNull(), 1)) if isinstance(x, str) else F.count(x)
    sxy, sx, sy = F.covar_pop(x, y) * n, F.var_pop(x) * n, F.var_pop(y) * n
    scale = F.sqrt(sx * sy)
    return F.when((n < 3) | (scale < 1e-15), small).otherwise(sxy / F.when(scale >= 1e-15, scale))


def finite(df: DataFrame, *names: str) -> DataFrame:
    for n in names:
        c = F.col(n)
        df = df.where(c.isNotNull() & ~F.isnan(c) & (F.abs(c) < dbl("inf")))
    return df


def spearman(df: DataFrame, x: str, y: str, by: Sequence[str] = (), out: str = "srcc", small=None) -> DataFrame:
    """Spearman coefficient with shared ranks. Equal (x, y) pairs are counted together
    first, so a frequent value costs one row per partner. Only a group's code, the values and
    their count travel; names are joined to the sums."""
    by = list(by)
    good = finite(df, x, y)
    cells = staged(good.groupBy(group_code(by).alias("_g"), F.col(x).alias("_x"), F.col(y).alias("_y")).agg(F.count(F.lit(1)).alias("_w")), "cells")
    n = cells.count()
    rank = F.col("_before") + (F.col("_run") + 1) / dbl(2)
    middle = (F.col("_size") + 1) / dbl(2)
    by_x = placed(cells, ["_g"], ["_x"], "_w", rows=n).select("_g", "_y", "_w", (rank - middle).alias("_dx"))
    both = placed(by_x, ["_g"], ["_y"], "_w", rows=n)
    dx, dy, w = F.col("_dx"), rank - middle, F.col("_w")
    sums = both.groupBy(*(["_g"] if by else [])).agg(F.sum("_w").alias("n"), F.sum(w * dx * dy).alias("_xy"),
                                                     F.sum(w * dx * dx).alias("_xx"), F.sum(w * dy * dy).alias("_yy"))
    value = F.when(F.col("n") < 3, F.lit(small).cast("double")).otherwise(
        safe_ratio(F.col("_xy"), F.sqrt(F.col("_xx") * F.col("_yy")), small))
    if by:
        sums = good.select(*by, group_code(by).alias("_g")).distinct().join(sums, "_g")
    return sums.select(*by, "n", value.alias(out))


def spearman_ordinal(df: DataFrame, x: str, y: str, key: str, by: Sequence[str] = (), out: str = "srcc") -> DataFrame:
    """1 - 6 sum d^2 / (n (n^2-1)) on ordinal ranks, ties broken by key; 0 below three rows."""
    by = list(by)
    placed = position(position(df, x, key, by, "_px"), y, key, by, "_py")
    n, gap = F.count(F.lit(1)), (F.col("_px") - F.col("_py")).cast("double")
    squared = F.sum(gap * gap)
    value = F.when(n < 3, dbl(0)).otherwise(
        dbl(1) - safe_ratio(squared * 6, n.cast("double") * (n.cast("double") * n - 1)))
    return placed.groupBy(*by).agg(n.alias("n"), value.alias(out))


def error_columns(pred: str, truth: str) -> list[Column]:
    gap = F.col(pred) - F.col(truth)
    return [F.avg(F.abs(gap)).alias("mae"), F.sqrt(F.avg(gap * gap)).alias("rmse"), F.avg(gap).alias("bias")]


def metrics(df: DataFrame, pred: str, truth: str, by: Sequence[str], small=None, min_rows: int = 0) -> DataFrame:
    """n, srcc, plcc, mae, rmse, bias per group; NULL metrics below ``min_rows``."""
    by = list(by)
    errors = df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), guarded_corr(pred, truth, small).alias("plcc"),
                                 *error_columns(pred, truth))
    ranked = spearman(df, pred, truth, by, small=small).drop("n")
    joined = attach(errors, ranked, by, "left") if by else attach(errors, ranked, by)
    enough = F.col("n") >= min_rows
    return joined.select(*by, "n", *[F.when(enough, F.col(c)).alias(c) for c in ("srcc", "plcc", "mae", "rmse", "bias")])


def weighted_over_dimensions(df: DataFrame, by: Sequence[str], columns: dict[str, str],
                             weights=DIMENSION_WEIGHTS) -> DataFrame:
    """Weighted sum over the dimension rows of each group, e.g. {'srcc': 'wsrcc'}."""
    weight = F.element_at(F.create_map(*[x for d, w in weights.items() for x in (F.lit(d), dbl(w))]), F.col("dimension"))
    return df.groupBy(*by).agg(*[F.sum(weight * F.col(c)).alias(o) for c, o in columns.items()])


# ---- p-values: result rows only, a handful per query -------------------------

def _t_two_sided(r: float, n: float) -> float:
    """Two-sided p of a correlation from Student's t by numeric integration of the tail."""
    if n is None or r is None or math.isnan(r) or n < 3:
        return float("nan")
    df = n - 2
    if abs(r) >= 1:
        return 0.0
    t = abs(r) * math.sqrt(df / (1 - r * r))
    # Regularised tail: substitute u = df/(df+s^2) and integrate by Gauss-Legendre on the angle.
    theta = math.atan(t / math.sqrt(df))
    nodes, weights = np.polynomial.legendre.leggauss(64)
    half = (math.pi / 2 - theta) / 2
    angle = theta + half * (nodes + 1)
    tail = half * float(np.sum(weights * np.cos(angle) ** (df - 1)))
    log_norm = math.lgamma((df + 1) / 2) - math.lgamma(df / 2) - 0.5 * math.log(math.pi)
    return min(1.0, 2 * math.exp(log_norm) * tail)


def correlation_p(df: DataFrame, r: str, n: str = "n", out: str = "p_value") -> DataFrame:
    @F.pandas_udf("double")
    def tail(rs: pd.Series, ns: pd.Series) -> pd.Series:
        return pd.Series([_t_two_sided(a, b) for a, b in zip(rs, ns)], dtype="float64")

    return df.withColumn(out, tail(F.col(r), F.col(n).cast("double")))


def normal_upper_tail(z: Column) -> Column:
    from ..functions.numerics import normal_cdf

    return dbl(1) - normal_cdf(z)


# ---- detection ---------------------------------------------------------------

def auroc(df: DataFrame, score: str, label: str, by: Sequence[str] = ()) -> DataFrame:
    """Area under the ROC curve by the rank sum, ties at half weight."""
    by = list(by)
    cells = df.groupBy(*by, score).agg(F.count(F.lit(1)).alias("_w"), F.sum(F.col(label).cast("long")).alias("_pos"))
    sums = average_rank(cells, score, by, "_r", "_w").groupBy(*by).agg(
        F.sum("_w").alias("n"), F.sum("_pos").alias("n_pos"), F.sum(F.col("_r") * F.col("_pos")).alias("_rs"))
    pos = F.col("n_pos").cast("double")
    neg = F.col("n").cast("double") - pos
    return sums.select(*by, "n", "n_pos", safe_ratio(F.col("_rs") - pos * (pos + 1) / 2, pos * neg).alias("auroc"))


def roc_points(df: DataFrame, score: str, label: str, by: Sequence[str] = ()) -> DataFrame:
    """One row per distinct score, highest first in meaning: true and false
    positives when everything at or above that score is flagged."""
    by = list(by)
    flipped = df.select(*by, (-F.col(score)).alias("_s"), F.col(label).cast("long").alias("_y"))
    all_rows = cumulative(flipped, "_s", by)
    positives = flipped.groupBy(*by, "_s").agg(F.sum("_y").alias("_p"))
    pos_cum = cumulative(positives, "_s", by, "_p").select(*by, "_s", F.col("cum").alias("tp"), F.col("size").alias("pos"))
    joined = all_rows.join(pos_cum, [*by, "_s"])
    return joined.select(*by, (-F.col("_s")).alias(score), "n", "tp", (F.col("cum") - F.col("tp")).alias("fp"),
                         "pos", (F.col("size") - F.col("pos")).alias("neg"), "cum")


def auprc(df: DataFrame, score: str, label: str, by: Sequence[str] = ()) -> DataFrame:
    """Trapezoid area under precision over recall, started at (recall 0, precision 1).

    The previous curve point of a score follows from its own counts (rows and
    positives strictly above it), so no ordered pass over the curve is needed.
    """
    by = list(by)
    own = df.groupBy(*by, score).agg(F.sum(F.col(label).cast("long")).alias("_p"))
    points = roc_points(df, score, label, by).join(own, [*by, score])
    tp, cum, pos = F.col("tp").cast("double"), F.col("cum").cast("double"), F.col("pos")
    tp0, cum0 = tp - F.col("_p"), cum - F.col("n")
    before = F.when(cum0 > 0, tp0 / F.when(cum0 > 0, cum0)).otherwise(dbl(1))
    area = safe_ratio((tp - tp0), pos, 0) * (tp / cum + before) / 2
    return points.groupBy(*by).agg(F.sum(area).alias("auprc"))


def fpr_at_tpr(df: DataFrame, score: str, label: str, target: float = 0.95, by: Sequence[str] = ()) -> DataFrame:
    """False positive rate at the highest score whose true positive rate reaches the target."""
    points = roc_points(df, score, label, by)
    reached = points.where(safe_ratio(F.col("tp"), F.col("pos")) >= target)
    fpr = safe_ratio(F.col("fp"), F.col("neg"))
    return reached.groupBy(*by).agg(F.max_by(fpr, F.col(score)).alias("fpr"))


# ---- rank tests ----------------------------------------------------------------

def wilcoxon_greater(df: DataFrame, difference: str, by: Sequence[str], min_rows: int = 5) -> DataFrame:
    """Signed-rank statistic (sum of positive ranks), one-sided p, mean difference.

    p is exact for at most 50 differences without ties or zeros, else normal. Groups
    below ``min_rows`` keep their row; statistic, p and mean are NULL there.
    """
    by = list(by)
    means = df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg(difference).alias("_mean"))
    nonzero = df.where(F.col(difference) != 0).withColumn("_a", F.abs(difference))
    cells = nonzero.groupBy(*by, "_a").agg(F.count(F.lit(1)).alias("_w"),
                                           F.count(F.when(F.col(difference) > 0, 1)).alias("_up"))
    w = F.col("_w").cast("double")
    sums = average_rank(cells, "_a", by, "_r", "_w").groupBy(*by).agg(
        F.sum("_w").alias("n_nonzero"), F.sum(F.col("_r") * F.col("_up")).alias("_statistic"),
        F.sum(w * w * w - w).alias("_ties"))
    m = F.col("n_nonzero").cast("double")
    spread = F.sqrt((m * (m + 1) * (2 * m + 1) - F.col("_ties") / 2) / 24)
    normal = normal_upper_tail(safe_ratio(F.col("_statistic") - m * (m + 1) / 4, spread, 0))
    rows = means.join(sums, by, "left").withColumn("_exact", exact_signed_rank(F.coalesce("n_nonzero", F.lit(0)), F.coalesce("_statistic", F.lit(0.0))))
    untied = (F.col("_ties") == 0) & (F.col("n_nonzero") == F.col("n"))
    enough = F.col("n") >= min_rows
    return rows.select(*by, "n", F.coalesce("n_nonzero", F.lit(0)).alias("n_nonzero"), F.when(enough, F.coalesce("_statistic", dbl(0))).alias("statistic"),
                       F.when(enough, F.coalesce(F.when(untied, F.col("_exact")), normal, dbl(1))).alias("p_value"), F.when(enough, F.col("_mean")).alias("mean_difference"))


def mann_whitney(df: DataFrame, value: str, group: Column, by: Sequence[str] = ()) -> DataFrame:
    """U of the rows where ``group`` is true, and the p of their values being smaller than the others'.

    p is exact where one side has at most 8 rows and no values tie, else normal with a
    continuity term of one half and corrected for ties.
    """
    by = list(by)
    cells = df.groupBy(*by, value).agg(F.count(F.lit(1)).alias("_w"), F.count(F.when(group, 1)).alias("_in"))
    w = F.col("_w").cast("double")
    sums = average_rank(cells, value, by, "_r", "_w").groupBy(*by).agg(
        F.sum("_w").alias("n"), F.sum("_in").alias("n_in"), F.sum(F.col("_r") * F.col("_in")).alias("_rs"),
        F.sum(w * w * w - w).alias("_ties"))
    n, a = F.col("n").cast("double"), F.col("n_in").cast("double")
    b, u = n - a, F.col("_rs") - a * (a + 1) / 2
    spread = F.sqrt(a * b / 12 * (n + 1 - safe_ratio(F.col("_ties"), n * (n - 1), 0)))
    normal = normal_upper_tail(-safe_ratio(u - a * b / 2 + dbl(0.5), spread, 0))
    rows = sums.withColumn("_exact", exact_mann_whitney(F.col("n_in"), F.col("n") - F.col("n_in"), u))
    return rows.select(*by, "n", "n_in", u.alias("u"), F.coalesce(F.when(F.col("_ties") == 0, F.col("_exact")), normal).alias("p_value"))


# ---- agreement between level assignments ----------------------------------------

def confusion(df: DataFrame, truth: str, pred: str, by: Sequence[str] = (), levels: int = 5) -> DataFrame:
    """Counts over the complete levels x levels grid of every group."""
    by = list(by)
    counted = df.groupBy(*by, truth, pred).agg(F.count(F.lit(1)).alias("n"))
    axis = F.sequence(F.lit(0), F.lit(levels - 1))
    grid = (df.select(*by).distinct() if by else df.agg(F.count(F.lit(1)).alias("_x")).drop("_x"))
    grid = grid.withColumn(truth, F.explode(axis)).withColumn(pred, F.explode(axis))
    return grid.join(counted, [*by, truth, pred], "left").select(*by, truth, pred, F.coalesce("n", F.lit(0)).alias("n"))


def kappas(cells: DataFrame, truth: str, pred: str, by: Sequence[str], levels: int = 5) -> DataFrame:
    """Cohen's kappa and its quadratically weighted form from confusion cells."""
    by = list(by)
    counts = lambda c, i: F.sum(F.when(F.col(c) == i, F.col("n")).otherwise(0)).cast("double")
    n = F.sum("n").cast("double")
    observed = safe_ratio(F.sum(F.when(F.col(truth) == F.col(pred), F.col("n")).otherwise(0)), n)
    gap = (F.col(truth) - F.col(pred)).cast("double") / (levels - 1)
    rows = cells.groupBy(*by).agg(
        n.alias("_n"), observed.alias("_po"), F.sum(gap * gap * F.col("n")).alias("_wo"),
        F.array(*[counts(truth, i) for i in range(levels)]).alias("_t"),
        F.array(*[counts(pred, i) for i in range(levels)]).alias("_p"))
    pairs = [(i, j) for i in range(levels) for j in range(levels)]
    cell = lambda i, j: F.element_at("_t", i + 1) * F.element_at("_p", j + 1)
    chance, expected = dbl(0), dbl(0)
    for i, j in pairs:
        if i == j:
            chance = chance + cell(i, j)
        expected = expected + dbl(((i - j) / (levels - 1)) ** 2) * cell(i, j)
    rows = rows.withColumn("_pe", safe_ratio(chance, F.col("_n") * F.col("_n"))).withColumn("_we", safe_ratio(expected, F.col("_n")))
    kappa = F.when(F.col("_pe") >= 1, dbl(1)).otherwise(safe_ratio(F.col("_po") - F.col("_pe"), dbl(1) - F.col("_pe")))
    qwk = F.when(F.col("_we") == 0, dbl(1)).otherwise(dbl(1) - safe_ratio(F.col("_wo"), F.col("_we")))
    return rows.select(*by, F.col("_n").cast("long").alias("n"), F.col("_po").alias("exact"), kappa.alias("kappa"), qwk.alias("qwk"))


