"""Rater panel queries: calibration, ensembles, disagreement (E, M1-M7, part of A, J, R)."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, functions as F

from ..functions.numerics import dbl, r6
from ..operators import agreement as ag, calibration as cal, ensemble as en, isotonic, uncertainty as un
from ..operators.ranking import attach_one, quantiles
from ..operators.staging import staged
from .oracle_views import VIEWS, WEIGHT, avg_rank, corr_sql, h, metrics_sql, r
from .registry import query

PAIRS = {"a": ("rater_af", "rater_ao"), "mixed": ("rater_nf", "rater_ro")}
BY = ["model", "dimension"]
METRICS = ("srcc", "plcc", "mae", "rmse", "bias")

VIEWS["scored"] = ("panel truth", "select p.*, gt, category, split from panel p join truth using (image_id, dimension)")


def scored(t):
    return staged(t.scored, "scored")


def rounded(df, keys, names=METRICS):
    return df.select(*keys, *[r6(c).alias(c) for c in names])


R_METRICS = ", ".join(f"{r(c)} as {c}" for c in METRICS)


@query("j1_predictions_with_grades", "scored", f"select image_id, dimension, model, {r('score')} as pred, {r('gt')} as gt from scored")
def j1(t):
    rows = t.panel.where(F.col("score").isNotNull()).join(t.truth.where(F.col("gt").isNotNull()), ["image_id", "dimension"])
    return rows.select("image_id", "dimension", "model", r6("score").alias("pred"), r6("gt").alias("gt"))


@query("j5_common_images", "panel_overall", """select distinct image_id from panel_overall group by 1
        having count(distinct model) = (select count(distinct model) from panel_overall)""")
def j5(t):
    return en.common_to_all(t.panel_overall).select("image_id").distinct()


@query("a2_minmax_scaling", "panel_overall", f"""select image_id, p.model, {r('(score - lo) / (hi - lo)')} as minmax, {r('(score - m) / s')} as z from panel_overall p
        join (select model, min(score) lo, max(score) hi, avg(score) m, stddev_samp(score) s from panel_overall group by 1) using (model)""")
def a2(t):
    params = t.panel_overall.groupBy("model").agg(F.min("score").alias("lo"), F.max("score").alias("hi"), F.avg("score").alias("m"), F.stddev_samp("score").alias("s"))
    c = F.col
    return t.panel_overall.join(params, "model").select("image_id", "model", r6((c("score") - c("lo")) / (c("hi") - c("lo"))).alias("minmax"),
                                                        r6((c("score") - c("m")) / c("s")).alias("z"))


@query("a10_mean_bias", "scored", f"select model, dimension, {r('avg(score - gt)')} as bias from scored group by 1, 2")
def a10(t):
    return rounded(cal.mean_bias(scored(t)), BY, ["bias"])


@query("m6_subtract_bias", "scored", f"""select image_id, model, dimension, {r('score - bias')} as score from scored
        join (select model, dimension, avg(score - gt) as bias from scored group by 1, 2) using (model, dimension)""")
def m6(t):
    rows = scored(t)
    return cal.subtract_bias(rows, cal.mean_bias(rows)).select("image_id", *BY, r6("score").alias("score"))


@query("a11_errors", "scored", f"""select model, dimension, {r('avg(abs(score - gt))')} as mae, {r('sqrt(avg((score - gt) * (score - gt)))')} as rmse,
        {r('avg(score - gt)')} as bias, {r('max(abs(score - gt))')} as max_error, {r('quantile_cont(abs(score - gt), 0.5)')} as median_error,
        {r('quantile_cont(abs(score - gt), 0.9)')} as p90_error from scored group by 1, 2""")
def a11(t):
    rows = scored(t).withColumn("error", F.abs(F.col("score") - F.col("gt")))
    plain = rows.groupBy(*BY).agg(*ag.error_columns("score", "gt"), F.max("error").alias("max_error"))
    cut = quantiles(rows, "error", {"median_error": 0.5, "p90_error": 0.9}, BY)
    return rounded(plain.join(cut, BY), BY, ["mae", "rmse", "bias", "max_error", "median_error", "p90_error"])


VIEWS["tier_rows"] = ("errors decided", "select d.dimension, d.tier, round(d.mos, 9) as mos, e.gt from decided d join errors e using (image_id, dimension)")


@query("a12_error_report", "tier_rows", f"select dimension, tier, n, case when n >= 10 then {r('srcc')} end as srcc, {r('mae')} as mae, {r('rmse')} as rmse, {r('bias')} as bias from m",
       m=metrics_sql("tier_rows", "mos", "gt", "dimension, tier"))
def a12(t):
    from .q_uncertainty import errors

    rows = un.decide(errors(t), with_reason=False).withColumn("mos", F.round("mos", 9))
    by = ["dimension", "tier"]
    return ag.metrics(rows, "mos", "gt", by).select(*by, "n", F.when(F.col("n") >= 10, r6("srcc")).alias("srcc"), *[r6(c).alias(c) for c in ("mae", "rmse", "bias")])


@query("r4_dimension_metrics", "scored", f"select model, dimension, n, {R_METRICS} from m", m=metrics_sql("scored", "score", "gt", "model, dimension"))
def r4(t):
    return ag.metrics(scored(t), "score", "gt", BY).select(*BY, "n", *[r6(c).alias(c) for c in METRICS])


@query("r4_wsrcc", "scored", f"select model, {r(f'sum({WEIGHT} * srcc)')} as wsrcc, {r(f'sum({WEIGHT} * mae)')} as wmae from m group by 1",
       m=metrics_sql("scored", "score", "gt", "model, dimension"))
def r4b(t):
    return rounded(en.single_results(scored(t)), ["model"], ["wsrcc", "wmae"])


VIEWS["pairs"] = ("panel", """select a.image_id, a.dimension, a.model as model_a, b.model as model_b, a.score as a, b.score as b
    from panel a join panel b on a.image_id = b.image_id and a.dimension = b.dimension and a.model < b.model""")


@query("j16_rater_pairs", "pairs", f"select image_id, dimension, model_a, model_b, {r('a - b')} as gap from pairs")
def j16(t):
    """Every pair of raters of every image."""
    return en.rater_pairs(t.panel).select("image_id", "dimension", "model_a", "model_b", r6(F.col("a") - F.col("b")).alias("gap"))


@query("a26_pair_disagreement", "pairs", f"""select model_x as model_a, model_y as model_b, {r('avg(abs(a - b))')} as mean_gap, count(*) as n from (
        select model_a as model_x, model_b as model_y, a, b from pairs where dimension = 'overall' union all
        select model_b, model_a, a, b from pairs where dimension = 'overall') group by 1, 2""")
def a26(t):
    pairs = en.rater_pairs(t.panel_overall, by=["image_id"])
    half = pairs.groupBy("model_a", "model_b").agg(F.avg(F.abs(F.col("a") - F.col("b"))).alias("mean_gap"), F.count(F.lit(1)).alias("n"))
    both = F.explode(F.array(F.struct("model_a", "model_b"), F.struct(F.col("model_b").alias("model_a"), F.col("model_a").alias("model_b"))))
    return half.select(both.alias("p"), "mean_gap", "n").select("p.model_a", "p.model_b", r6("mean_gap").alias("mean_gap"), "n")


@query("r25_residual_correlation", "scored", f"select model_a, model_b, {r('avg(c)')} as r from c group by 1, 2",
       c=f"""select a.model as model_a, b.model as model_b, a.dimension, {corr_sql('(a.score - a.gt)', '(b.score - b.gt)', '0e0')} as c
             from scored a join scored b on a.image_id = b.image_id and a.dimension = b.dimension and a.model < b.model group by 1, 2, 3""")
def r25(t):
    residuals = scored(t).withColumn("e", F.col("score") - F.col("gt"))
    pairs = en.rater_pairs(residuals, "e")
    per_dim = pairs.groupBy("model_a", "model_b", "dimension").agg(ag.guarded_corr("a", "b", 0.0).alias("c"))
    return per_dim.groupBy("model_a", "model_b").agg(r6(F.avg("c")).alias("r"))


A27 = """select image_id, split, avg(z) filter (model in ('rater_af', 'rater_ao')) as v, avg(z) filter (model in ('rater_rf', 'rater_ro')) as l,
    stddev_samp(z) filter (model in ('rater_af', 'rater_ao')) as sv, stddev_samp(z) filter (model in ('rater_rf', 'rater_ro')) as sl
    from normed join truth_wide using (image_id) group by 1, 2 having v is not null and l is not null"""


@query("a27_cluster_divergence", "normed truth_wide", f"""select split, count(*) as n, {r('avg(abs(v - l))')} as gap_mean, {r('stddev_samp(abs(v - l))')} as gap_std,
        {r('avg(sv)')} as within_vision, {r('avg(sl)')} as within_language, {r('avg(abs(v - l)) / greatest((avg(sv) + avg(sl)) / 2, 1e-8::double)')} as ratio,
        {r('avg(coalesce(abs(v - l) > (sv + sl) / 2, false)::int) * 100')} as share_larger from g group by 1""", g=A27)
def a27(t):
    from .q_uncertainty import LANGUAGE, VISION

    normed = un.normalise(t.panel_overall, un.fit_normaliser(t.panel_overall)).join(t.truth_wide.select("image_id", "split"), "image_id")
    z = lambda names: F.when(F.col("model").isin(*names), F.col("z"))
    g = normed.groupBy("image_id", "split").agg(F.avg(z(VISION)).alias("v"), F.avg(z(LANGUAGE)).alias("l"),
                                                F.stddev_samp(z(VISION)).alias("sv"), F.stddev_samp(z(LANGUAGE)).alias("sl")).where("v is not null and l is not null")
    gap, within = F.abs(F.col("v") - F.col("l")), (F.col("sv") + F.col("sl")) / 2
    return g.groupBy("split").agg(
        F.count(F.lit(1)).alias("n"), r6(F.avg(gap)).alias("gap_mean"), r6(F.stddev_samp(gap)).alias("gap_std"), r6(F.avg("sv")).alias("within_vision"),
        r6(F.avg("sl")).alias("within_language"), r6(F.avg(gap) / F.greatest((F.avg("sv") + F.avg("sl")) / 2, dbl(1e-8))).alias("ratio"), r6(F.avg(F.coalesce(gap > within, F.lit(False)).cast("int")) * 100).alias("share_larger"))


LINE = "select model, dimension, count(*) as n, regr_slope(gt, score) as slope, regr_intercept(gt, score) as intercept from scored group by 1, 2"


@query("m1_linear_fit", "scored", f"select model, dimension, n, {r('slope')} as slope, {r('intercept')} as intercept from l", l=LINE)
def m1(t):
    return cal.linear_fit(scored(t)).select(*BY, "n", r6("slope").alias("slope"), r6("intercept").alias("intercept"))


@query("m4_apply_linear", "scored", f"select image_id, s.model, s.dimension, {r('slope * score + intercept')} as score from scored s join l using (model, dimension)", l=LINE)
def m4(t):
    rows = scored(t)
    return cal.apply_linear(rows, cal.linear_fit(rows)).select("image_id", *BY, r6("score").alias("score"))


FOLD = f"select *, ({h(repr('fold'), 'image_id')} % 5)::int as fold from scored where split <> 'test'"
FOLD_PARAMS = "select model, dimension, k as fold, regr_slope(gt, score) as slope, regr_intercept(gt, score) as intercept from f, range(5) x(k) where fold <> k group by 1, 2, 3"
FOLDED = "select f.*, slope * score + intercept as calibrated from f join fp using (model, dimension, fold)"


@query("m5_cross_validated_linear", "scored", f"select image_id, model, dimension, fold, {r('calibrated')} as calibrated from ({FOLDED})", f=FOLD, fp=FOLD_PARAMS)
def m5(t):
    """The out-of-fold corrected score of every row."""
    return cal.folded_linear(scored(t).where(F.col("split") != "test")).select("image_id", *BY, "fold", r6("calibrated").alias("calibrated"))


# The increasing fit as SQL: at every distinct score the largest, over starts, of the smallest mean over ends.
def increasing_sql(source, prefix):
    by = "model, dimension"
    return {
        f"{prefix}cells": f"select {by}, score as x, count(*) as w, sum(gt) as s from {source} group by all",
        f"{prefix}sums": f"select *, row_number() over o as i, sum(w) over o as cw, sum(s) over o as cs from {prefix}cells window o as (partition by {by} order by x)",
        f"{prefix}means": f"select a.model, a.dimension, a.i, b.x, b.w, (b.cs - a.cs + a.s) / (b.cw - a.cw + a.w) as mean from {prefix}sums a join {prefix}sums b on a.model = b.model and a.dimension = b.dimension and b.i >= a.i",
        f"{prefix}lows": f"select {by}, x, w, min(mean) over (partition by {by}, i order by x desc rows unbounded preceding) as low from {prefix}means",
        f"{prefix}fit": f"select {by}, x, any_value(w) as w, round(max(low), 9) as value from {prefix}lows group by 1, 2, 3"}


TRAINED = dict(l=LINE.replace("from scored", "from scored where split = 'train'"), **increasing_sql("(select * from scored where split = 'train')", "i"))
CALIBRATED = """select s.model, s.dimension, s.image_id, s.split, s.score, s.gt, slope * s.score + intercept as linear, case when a.x is null then b.value when b.x is null or a.x = b.x then a.value
    else a.value + (b.value - a.value) * ((s.score - a.x) / (b.x - a.x)) end as isotonic from scored s left join l using (model, dimension)
    asof left join ifit a on s.model = a.model and s.dimension = a.dimension and s.score >= a.x asof left join ifit b on s.model = b.model and s.dimension = b.dimension and s.score <= b.x"""
COMPARED = """select model, dimension, split, gt, 0 as nth, 'raw' as method, round(score, 9) as value from cal union all select model, dimension, split, gt, 1, 'linear', round(linear, 9) from cal where linear is not null
    union all select model, dimension, split, gt, 2, 'isotonic', round(isotonic, 9) from cal where isotonic is not null"""
PLAIN_METHODS = ("raw", "linear", "isotonic")
M7 = dict(**TRAINED, cal=CALIBRATED, long=COMPARED, m=metrics_sql("long", "value", "gt", "model, dimension, split, nth, method"),
          worst="select model, dimension, split, method, max(abs(value - gt)) as max_error from long group by all")


def compared(t, methods):
    rows = staged(cal.calibrated(scored(t), F.col("split") == "train", BY, methods), "calibrated")
    return cal.compare(rows, [*BY, "split"], methods)


@query("m7_fit_summary", "scored", f"""select model, dimension, split, method, n, {r('srcc')} as srcc, {r('plcc')} as plcc, {r('mae')} as mae, {r('rmse')} as rmse, {r('bias')} as bias, {r('max_error')} as max_error,
        row_number() over (g order by round(mae, 9), nth) = 1 as best, {r('(raw_mae - mae) / raw_mae * 100', 5)} as reduction_pct from (
        select *, max(mae) filter (nth = 0) over (partition by model, dimension, split) as raw_mae from m join worst using (model, dimension, split, method) where n >= 30) window g as (partition by model, dimension, split)""", **M7)
def m7(t):
    """Raw, linear and increasing calibration, fitted on the training split, judged on every split."""
    done = compared(t, PLAIN_METHODS)
    return done.select(*BY, "split", "method", "n", *[r6(c).alias(c) for c in ("srcc", "plcc", "mae", "rmse", "bias", "max_error")], "best", r6("reduction_pct", 5).alias("reduction_pct"))


@query("m7_weighted", "scored", f"select model, split, method, {r(f'sum({WEIGHT} * srcc)')} as wsrcc, {r(f'sum({WEIGHT} * mae)')} as wmae from m where n >= 30 group by 1, 2, 3", **M7)
def m7_weighted(t):
    """Coefficient and error of every method, weighted over dimensions, per rater and split."""
    return rounded(ag.weighted_over_dimensions(compared(t, PLAIN_METHODS), ["model", "split", "method"], {"srcc": "wsrcc", "mae": "wmae"}), ["model", "split", "method"], ["wsrcc", "wmae"])


@query("m7_all_methods")
def m7_all(t):
    """The same comparison with the logistic curve among the methods."""
    return compared(t, cal.METHODS)


@query("m2_logistic_fit")
def m2(t):
    """Four- and five-parameter curves per rater and dimension: error and whether the fit converged."""
    rows = scored(t)
    parts = []
    for parameters in (4, 5):
        fit = staged(cal.logistic_fit(rows, by=BY, parameters=parameters), "curves")
        gap = F.col("calibrated") - F.col("gt")
        done = cal.apply_logistic(rows, fit, BY, parameters=parameters).groupBy(*BY).agg(F.count(F.lit(1)).alias("n"), F.sqrt(F.avg(gap * gap)).alias("rmse"))
        parts.append(done.join(fit.select(*BY, "converged"), BY).withColumn("parameters", F.lit(parameters)))
    return parts[0].unionByName(parts[1])


FUSED = "select model, dimension, score, gt from scored union all select 'fused', dimension, mu, gt from paired"


@query("m3_isotonic_fit", "scored paired", f"select model, dimension, min(x) as lo, max(x) as hi, sum(w)::bigint as n, {r('value')} as value from ifit group by model, dimension, value",
       every=FUSED, **increasing_sql("every", "i"))
def m3(t):
    """Blocks of the increasing fit of every rater and of the fused prediction, per dimension."""
    fused = t.paired.select(F.lit("fused").alias("model"), "dimension", F.col("mu").cast("double").alias("score"), "gt")
    rows = scored(t).select("model", "dimension", F.col("score").cast("double").alias("score"), "gt").unionByName(fused)
    return isotonic.fit(rows, BY).select(*BY, "lo", "hi", "n", r6("value").alias("value"))


@query("r5_main_score")
def r5(t):
    """Weighted mean of rank and logistic-mapped linear coefficients over dimensions."""
    rows = scored(t)
    fit = cal.logistic_fit(rows, by=BY)
    mapped = staged(cal.apply_logistic(rows, fit, BY), "mapped")
    plcc = mapped.groupBy(*BY).agg(ag.guarded_corr("calibrated", "gt").alias("mapped_plcc"), ag.guarded_corr("score", "gt").alias("raw_plcc"))
    both = ag.spearman(mapped, "score", "gt", BY).join(plcc, BY)
    half = dbl(0.5) * (F.abs("srcc") + F.abs(F.coalesce("mapped_plcc", "raw_plcc")))
    return ag.weighted_over_dimensions(both.withColumn("half", half), ["model"], {"half": "main_score"})


Z = "select *, (score - m) / s as z from scored join (select model, dimension, avg(score) m, stddev_pop(score) s from scored group by 1, 2) using (model, dimension)"


@query("r6_cubic_plcc", "paired", f"select dimension, n, {r('srcc')} as srcc, {r('plcc', 5)} as plcc, {r('0.5e0 * srcc + 0.5e0 * plcc', 5)} as combined from w",
       z="""select p.*, (mu - m) / s as z from paired p join (select dimension, avg(mu) m, stddev_pop(mu) s from paired group by 1) using (dimension)""",
       o1="select dimension, avg(z*z*z) as b, avg(z*z) as c from z group by 1",
       basis="""select image_id, dimension, mu, gt, z, z*z - c - b*z as p2 from z join o1 using (dimension)""",
       o2="select dimension, avg(z*z*z) as k0, avg(z*z*z*z) as k1, avg(z*z*z*p2)/avg(p2*p2) as k2 from basis group by 1",
       b3="select *, z*z*z - k0 - k1*z - k2*p2 as p3 from basis join o2 using (dimension)",
       co="select dimension, avg(gt) as c0, avg(gt*z) as c1, avg(gt*p2)/avg(p2*p2) as c2, avg(gt*p3)/avg(p3*p3) as c3 from b3 group by 1",
       f="select b3.*, c0 + c1*z + c2*p2 + c3*p3 as fitted from b3 join co using (dimension)",
       w=f"select dimension, count(*) as n, {corr_sql('rx', 'ry')} as srcc, {corr_sql('fitted', 'gt')} as plcc from (select *, {avg_rank('mu', 'dimension')} as rx, {avg_rank('gt', 'dimension')} as ry from f) group by 1")
def r6_query(t):
    rows = staged(t.paired.select("image_id", "dimension", "mu", "gt"), "paired")
    fitted = cal.cubic_fit(rows, "mu", "gt", ["dimension"])
    plcc = fitted.groupBy("dimension").agg(ag.guarded_corr("fitted", "gt").alias("plcc"))
    both = ag.spearman(rows, "mu", "gt", ["dimension"]).join(plcc, "dimension")
    return both.select("dimension", "n", r6("srcc").alias("srcc"), r6("plcc", 5).alias("plcc"), r6(dbl(0.5) * F.col("srcc") + dbl(0.5) * F.col("plcc"), 5).alias("combined"))


# ---- consensus and ensembles -------------------------------------------------------------

JUDGES = """select image_id, dimension, max(score) filter (model = 'rater_af') as p, max(score) filter (model = 'rater_no') as s,
    max(score) filter (model = 'rater_ro') as b from panel group by 1, 2"""
VIEWS["consensus"] = ("panel", f"""select *, case when p is null or s is null then coalesce(p, s) when abs(p - s) > 1 and b is not null then list_sort([p, s, b])[2] else (p + s) / 2 end as mos,
    case when p is null or s is null then 0.8e0 when abs(p - s) > 1 and b is not null then greatest(0.4e0, list_stddev_pop([p, s, b])) else abs(p - s) / 2 + 0.4e0 end as std,
    p is not null and s is not null and coalesce(abs(p - s) <= 1, false) as agreement,
    p is not null and s is not null and coalesce(abs(p - s) > 1, false) and b is not null as tiebreaker_used from ({JUDGES})""")


def consensus_rows(t):
    pick = lambda m: F.max(F.when(F.col("model") == m, F.col("score")))
    judges = t.panel.groupBy("image_id", "dimension").agg(pick("rater_af").alias("p"), pick("rater_no").alias("s"), pick("rater_ro").alias("b"))
    return judges.withColumn("c", en.consensus(F.col("p"), F.col("s"), F.col("b"))).select("image_id", "dimension", "p", "s", "b", "c.*")


@query("e1_consensus", "consensus", f"select image_id, dimension, {r('mos')} as mos, {r('std')} as std, agreement, tiebreaker_used from consensus")
def e1(t):
    return consensus_rows(t).select("image_id", "dimension", r6("mos").alias("mos"), r6("std").alias("std"), "agreement", "tiebreaker_used")


@query("a23_consensus_progress", "consensus truth", f"""select source, count(*) as n, count(mos) as labelled, count(*) filter (agreement) as agreements,
        count(*) filter (tiebreaker_used) as tiebreakers, count(*) filter (mos is null) as failures,
        {r('sum(((p is not null)::int + (s is not null)::int) * 0.002e0 + tiebreaker_used::int * 0.01e0)')} as cost
        from consensus join truth using (image_id, dimension) group by 1""")
def a23(t):
    rows = consensus_rows(t).join(t.truth.select("image_id", "dimension", "source"), ["image_id", "dimension"])
    hit = lambda c: F.count(F.when(c, 1))
    calls = (F.col("p").isNotNull().cast("int") + F.col("s").isNotNull().cast("int")) * dbl(0.002) + F.col("tiebreaker_used").cast("int") * dbl(0.01)
    return rows.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.count("mos").alias("labelled"), hit(F.col("agreement")).alias("agreements"),
                                      hit(F.col("tiebreaker_used")).alias("tiebreakers"), hit(F.col("mos").isNull()).alias("failures"), r6(F.sum(calls)).alias("cost"))


VIEWS["common"] = ("scored", "select * from scored where image_id in (select image_id from panel group by 1 having count(distinct model) = (select count(distinct model) from panel))")


@query("e2_mean_median_ensemble", "common", f"select image_id, dimension, {r('avg(score)')} as mean, {r('median(score)')} as median from common group by 1, 2")
def e2(t):
    return en.common_to_all(scored(t)).groupBy("image_id", "dimension").agg(r6(F.avg("score")).alias("mean"), r6(F.median("score")).alias("median"))


VIEWS["single_dim"] = ("scored", metrics_sql("scored", "score", "gt", "model, dimension"))
VIEWS["singles"] = ("single_dim", f"select model, max(n) as n, avg(mae) as mean_mae, sum({WEIGHT} * srcc) as wsrcc, sum({WEIGHT} * mae) as wmae from single_dim where n >= 10 group by 1")
VIEWS["weights"] = ("singles", "select model, wsrcc, 1e0 / greatest(mean_mae, 0.01e0) as inverse_mae, greatest(wsrcc, 0.01e0) as wsrcc_weight from singles")


@query("e4_weights", "weights", f"select model, {r('inverse_mae')} as inverse_mae, {r('wsrcc_weight')} as wsrcc_weight from weights")
def e4(t):
    return rounded(en.derived_weights(en.single_results(scored(t))), ["model"], ["inverse_mae", "wsrcc_weight"])


@query("e3_weighted_ensemble", "common weights", f"select image_id, dimension, {r('sum(inverse_mae * score) / sum(inverse_mae)')} as score from common join weights using (model) group by 1, 2")
def e3(t):
    rows = scored(t)
    weights = en.derived_weights(en.single_results(rows)).select("model", "inverse_mae")
    joined = en.common_to_all(rows).join(weights, "model")
    return joined.groupBy("image_id", "dimension").agg(r6(F.sum(F.col("inverse_mae") * F.col("score")) / F.sum("inverse_mae")).alias("score"))


def member_sql(weights, top):
    parts = [f"select model as config, 'mean' as method, model, 1e0 as weight, 1 as size from {weights}"]
    for name, members in PAIRS.items():
        parts.append(f"select 'pair {name}', 'mean', model, 1e0, 2 from {weights} where model in {members}")
    for method in ("mean", "median"):
        parts.append(f"select 'top3 {method}', '{method}', model, 1e0, 3 from {top}")
        parts.append(f"select 'all {method}', '{method}', model, 1e0, (select count(*) from {weights}) from {weights}")
    parts.append(f"select 'all inverse mae', 'weighted', model, inverse_mae, (select count(*) from {weights}) from {weights}")
    parts.append(f"select 'all wsrcc', 'weighted', model, wsrcc_weight, (select count(*) from {weights}) from {weights}")
    return " union all ".join(parts)


def combined_sql(scores, members, extra=""):
    keys = f"{extra}config, image_id, dimension"
    return f"""select {keys}, round(case max(method) when 'median' then median(score) when 'weighted' then sum(weight * score) / sum(weight) else avg(score) end, 9) as score,
        max(gt) as gt from {scores} join {members} using ({extra}model) group by {keys} having count(*) = max(size)"""


VIEWS["members"] = ("weights", member_sql("weights", "(select model from weights order by wsrcc desc, model limit 3)"))
VIEWS["config_scores"] = ("members scored", combined_sql("scored", "members"))
VIEWS["config_dim"] = ("config_scores", metrics_sql("config_scores", "score", "gt", "config, dimension"))
CONFIG_OUT = (f"case when n >= 10 then {r(f'w')} end as wsrcc, case when n >= 10 then {r('e')} end as wmae")


@query("e5_configurations", "config_dim", f"select config, coalesce(n, 0) as n, {CONFIG_OUT} from (select distinct config from members) left join g using (config)",
       g=f"select config, max(n) as n, sum({WEIGHT} * srcc) as w, sum({WEIGHT} * mae) as e from config_dim group by 1")
def e5(t):
    return en.run_configurations(scored(t), PAIRS).select("config", "n", r6("wsrcc").alias("wsrcc"), r6("wmae").alias("wmae"))


VIEWS["pair_rows"] = ("pairs truth", "select model_a, model_b, p.image_id, p.dimension, round((a + b) / 2, 9) as score, gt from pairs p join truth using (image_id, dimension)")
VIEWS["pair_dim"] = ("pair_rows", metrics_sql("pair_rows", "score", "gt", "model_a, model_b, dimension"))


@query("e6_pair_gain", "pair_dim singles", f"""select model_a, model_b, g.n, {r('case when g.n >= 10 then w else 0e0 end')} as wsrcc,
        {r('case when g.n >= 10 then w else 0e0 end - greatest(x.wsrcc, y.wsrcc)')} as gain from g join singles x on x.model = model_a join singles y on y.model = model_b""",
       g=f"select model_a, model_b, max(n) as n, sum({WEIGHT} * srcc) as w from pair_dim group by 1, 2")
def e6(t):
    return en.pair_gains(scored(t)).select("model_a", "model_b", "n", r6("wsrcc").alias("wsrcc"), r6("gain").alias("gain"))


@query("e7_comparison", "scored", f"select version, part, config, n, {CONFIG_OUT} from g",
       idr="select image_id, dimension, model, score, gt, split from scored where split <> 'test'", odr="select image_id, dimension, model, score, gt from scored where split = 'test'",
       bi="select model, dimension, avg(score - gt) as b from idr group by 1, 2", li="select model, dimension, regr_slope(gt, score) as k, regr_intercept(gt, score) as c from idr group by 1, 2",
       f=FOLD, fp=FOLD_PARAMS, fd=FOLDED,
       ver="""select 'raw' as version, 'id' as part, image_id, dimension, model, score, gt from idr union all select 'raw', 'ood', image_id, dimension, model, score, gt from odr
            union all select 'bias', 'id', image_id, dimension, model, score - b, gt from idr join bi using (model, dimension)
            union all select 'bias', 'ood', image_id, dimension, model, score - b, gt from odr join bi using (model, dimension)
            union all select 'cv', 'id', image_id, dimension, model, calibrated, gt from fd
            union all select 'cv', 'ood', image_id, dimension, model, k * score + c, gt from odr join li using (model, dimension)""",
       sd=metrics_sql("(select * from ver where part = 'id')", "score", "gt", "version, model, dimension"),
       sw=f"select version, model, 1e0 / greatest(avg(mae), 0.01e0) as inverse_mae, sum({WEIGHT} * srcc) as wsrcc, greatest(sum({WEIGHT} * srcc), 0.01e0) as wsrcc_weight from sd where n >= 10 group by 1, 2",
       t3="select model from sw where version = 'raw' order by wsrcc desc, model limit 3",
       mem=" union all ".join(f"select '{v}' as version, * from ({member_sql(f'(select * from sw where version = {chr(39)}{v}{chr(39)})', 't3')})" for v in ("raw", "bias", "cv")),
       cs=combined_sql("(select *, part as p2 from ver)", "mem", "version, ").replace("group by version,", "group by part, version,").replace("select version, config", "select part, version, config", 1),
       cd=metrics_sql("cs", "score", "gt", "version, part, config, dimension"),
       g=f"select version, part, config, max(n) as n, sum({WEIGHT} * srcc) as w, sum({WEIGHT} * mae) as e from cd group by 1, 2, 3")
def e7(t):
    rows = staged(t.scored.select("image_id", "dimension", "model", "score", "gt", "split"), "scored")
    known, new = rows.where(F.col("split") != "test"), rows.where(F.col("split") == "test")
    bias, lines = staged(cal.mean_bias(known), "bias"), staged(cal.linear_fit(known), "lines")
    folded = cal.folded_linear(known).withColumn("score", F.col("calibrated")).select(*rows.columns)
    versions = {"raw": (known, new), "bias": (cal.subtract_bias(known, bias), cal.subtract_bias(new, bias)),
                "cv": (folded, cal.apply_linear(new, lines))}
    parts = [df.select(*rows.columns, F.lit(name).alias("version")) for name, both in versions.items() for df in both]
    every = staged(functools.reduce(DataFrame.unionByName, parts).withColumn("part", F.when(F.col("split") == "test", "ood").otherwise("id")).drop("split"), "versions")
    singles = staged(en.single_results(every.where("part = 'id'"), ["version"]), "singles")
    of = lambda name: singles.where(F.col("version") == name).drop("version")
    top = staged(en.best_three(of("raw")), "top")
    members = staged(functools.reduce(DataFrame.unionByName, [en.memberships(of(name), PAIRS, top).withColumn("version", F.lit(name)) for name in versions]), "members")
    done = en.evaluate(en.combine(every, members, ["version"], ["part"]), by=["version", "part", "config"])
    return done.select("version", "part", "config", "n", r6("wsrcc").alias("wsrcc"), r6("wmae").alias("wmae"))


@query("w11_best_item", "singles", f"select arg_max(model, wsrcc) as model, {r('max(wsrcc)')} as wsrcc from singles")
def w11(t):
    return en.single_results(scored(t)).agg(F.max_by("model", F.struct("wsrcc", "model")).alias("model"), r6(F.max("wsrcc")).alias("wsrcc"))


VIEWS["veto_rows"] = ("panel preds", "select p.image_id, p.dimension, p.model, round(abs(score - greatest(1e0, least(5e0, mu))), 9) as gap from panel p join preds using (image_id, dimension) where p.image_id in (select image_id from panel group by 1 having count(distinct model) = (select count(distinct model) from panel))")
GRID = (0.5, 1.0, 1.5, 2.0, 2.5)
GRID_SQL = "(select unnest([0.5e0, 1e0, 1.5e0, 2e0, 2.5e0]) as threshold)"


def veto_rows(t):
    from ..functions.numerics import clip

    rows = en.common_to_all(t.panel).join(t.preds.select("image_id", "dimension", "mu"), ["image_id", "dimension"])
    return staged(rows.select("image_id", "dimension", "model", F.round(F.abs(F.col("score") - clip(F.col("mu"), 1, 5)), 9).alias("gap")), "veto")


def thresholds():
    return F.explode(F.array(*[dbl(v) for v in GRID])).alias("threshold")


@query("a15_veto_sweep", "veto_rows", f"""select threshold, model, dimension, count(*) as n_total, count(*) filter (gap >= threshold) as n_vetoed,
        {r('count(*) filter (gap >= threshold) * 1e0 / count(*)')} as veto_rate, {r('avg(gap)')} as mean_gap, {r('median(gap)')} as median_gap
        from veto_rows, {GRID_SQL} group by 1, 2, 3""")
def a15(t):
    rows = veto_rows(t)
    n, hit = F.count(F.lit(1)), F.count(F.when(F.col("gap") >= F.col("threshold"), 1))
    counts = rows.select("*", thresholds()).groupBy("threshold", *BY).agg(n.alias("n_total"), hit.alias("n_vetoed"), r6(hit / n).alias("veto_rate"), r6(F.avg("gap")).alias("mean_gap"))
    middle = quantiles(rows, "gap", {"median_gap": 0.5}, BY).select(*BY, r6("median_gap").alias("median_gap"))
    return counts.join(middle, BY)


@query("a16_majority_veto", "veto_rows", f"""select threshold, dimension, count(*) as n_total, count(*) filter (votes >= ceil(k / 2e0)) as n_vetoed, {r('avg(mean_gap)')} as mean_gap from (
        select threshold, dimension, image_id, count(*) filter (gap >= threshold) as votes, count(*) as k, avg(gap) as mean_gap from veto_rows, {GRID_SQL} group by 1, 2, 3) group by 1, 2""")
def a16(t):
    votes = veto_rows(t).select("*", thresholds()).groupBy("threshold", "dimension", "image_id").agg(
        F.count(F.when(F.col("gap") >= F.col("threshold"), 1)).alias("votes"), F.count(F.lit(1)).alias("k"), F.avg("gap").alias("mean_gap"))
    return votes.groupBy("threshold", "dimension").agg(F.count(F.lit(1)).alias("n_total"), F.count(F.when(F.col("votes") >= F.ceil(F.col("k") / 2), 1)).alias("n_vetoed"), r6(F.avg("mean_gap")).alias("mean_gap"))
