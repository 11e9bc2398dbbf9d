"""Level-distribution queries (D)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import levels as lv
from ..functions.bins import gaussian_bins
from ..functions.numerics import dbl, r6
from ..operators import records
from .oracle_views import (LEVELS_DOWN, LEVELS_UP, entropy_sql, gaussian_sql, jsd_sql, level_columns, mos_sql, r,
                           scaled_sql, std_sql, two_level_sql)
from .registry import query

KEYS = ("image_id", "dimension")
BOTH = "labelled cross_levels"
JOINED = "select * from labelled join cross_levels using (image_id, dimension)"
BINS_UP = [round(c + 0.2, 10) for c in lv.BIN_CENTRES]
BINS_DOWN = [round(c - 0.2, 10) for c in lv.BIN_CENTRES]


def both(t):
    return t.labelled.join(t.cross_levels, list(KEYS))


RAW = "select image_id, [q, d, t, q * d, t - d] as raw from base"
WHY = """case when list_min(raw) < -1e-12 then 'negative'
    when list_sum(list_transform(raw, lambda v: greatest(v, 0e0))) < 1e-12 then 'no mass' end"""


@query("d1_validate", "base", f"select image_id, why, {level_columns('p')} from fixed", raws=RAW,
       fixed=f"select image_id, {WHY} as why, case when ({WHY}) is null then list_transform(raw, lambda v: v / list_sum(raw)) end as p from raws")
def d1(t):
    raw = t.base.select("image_id", F.array("q", "d", "t", F.col("q") * F.col("d"), F.col("t") - F.col("d")).alias("raw"))
    why = lv.problem(F.col("raw"))
    fixed = raw.select("image_id", why.alias("why"), F.when(why.isNull(), lv.checked(F.col("raw"))).alias("p"))
    return fixed.select("image_id", "why", *lv.columns(F.col("p")))


KL_TERM = "case when x[1] <= 1e-12 then 0e0 when x[2] <= 1e-12 then 'inf'::double else x[1] * ln(x[1] / x[2]) end"


@query("d2_kl", BOTH, f"select image_id, dimension, kl = 'inf'::double as unbounded, case when kl < 'inf'::double then {r('kl')} end as kl from v",
       j=JOINED, v=f"select image_id, dimension, list_sum(list_transform(list_zip(cross_probs, probs), lambda x: {KL_TERM})) as kl from j")
def d2(t):
    v = both(t).select(*KEYS, lv.kl(F.col("cross_probs"), F.col("probs")).alias("kl"))
    endless = F.col("kl") == dbl("inf")
    return v.select(*KEYS, endless.alias("unbounded"), F.when(~endless, r6("kl")).alias("kl"))


@query("d3_jsd", BOTH, f"select image_id, dimension, {r(jsd_sql('probs', 'cross_probs'))} as jsd from j", j=JOINED)
def d3(t):
    return both(t).select(*KEYS, r6(lv.jsd(F.col("probs"), F.col("cross_probs"))).alias("jsd"))


@query("d4_entropy", "labelled", f"select image_id, dimension, {r(entropy_sql('probs'))} as entropy from labelled")
def d4(t):
    return t.labelled.select(*KEYS, r6(lv.entropy(F.col("probs"))).alias("entropy"))


MIX = "select *, list_transform(list_zip(probs, cross_probs), lambda x: (x[1] + x[2]) / 2) as mix from labelled left join cross_levels using (image_id, dimension)"
BALD_SQL = f"case when cross_probs is null then 0e0 else greatest(0e0, {entropy_sql('mix')} - ({entropy_sql('probs')} + {entropy_sql('cross_probs')}) / 2) end"


@query("d5_bald", BOTH, f"select image_id, dimension, {r(BALD_SQL)} as bald from j", j=MIX)
def d5(t):
    members = F.filter(F.array("probs", "cross_probs"), lambda m: m.isNotNull())
    return t.labelled.join(t.cross_levels, list(KEYS), "left").select(*KEYS, r6(lv.bald(members)).alias("bald"))


@query("d6_gaussian_levels", "clamped", f"select image_id, dimension, {level_columns('p')} from v",
       v=f"select image_id, dimension, {gaussian_sql('m', 's', LEVELS_UP, LEVELS_DOWN)} as p from clamped")
def d6(t):
    p = lv.gaussian_levels(F.col("mu"), lv.floored_sigma(F.col("sigma_sq")))
    return t.preds.select(*KEYS, p.alias("p")).select(*KEYS, *lv.columns(F.col("p")))


@query("d7_two_level", "clamped", f"select image_id, dimension, {level_columns('p')} from v",
       v=f"select image_id, dimension, {two_level_sql('m')} as p from clamped")
def d7(t):
    return t.preds.select(*KEYS, lv.two_level(F.col("mu")).alias("p")).select(*KEYS, *lv.columns(F.col("p")))


@query("d8_prediction_levels", "labelled", f"select image_id, dimension, {level_columns('probs')} from labelled")
def d8(t):
    return t.labelled.select(*KEYS, *lv.columns(F.col("probs")))


@query("d9_mos", "labelled", f"select image_id, dimension, {r(mos_sql('probs'))} as mos from labelled")
def d9(t):
    return t.labelled.select(*KEYS, r6(lv.mos(F.col("probs"))).alias("mos"))


@query("d10_std", "labelled", f"select image_id, dimension, {r(std_sql('probs', 'mos'))} as std from v",
       v=f"select *, {mos_sql('probs')} as mos from labelled")
def d10(t):
    return t.labelled.select(*KEYS, r6(lv.std(F.col("probs"))).alias("std"))


@query("d11_named_levels", "cross_levels", f"select image_id, dimension, {level_columns('cross_probs')} from cross_levels")
def d11(t):
    return t.cross_levels.select(*KEYS, *lv.columns(F.col("cross_probs")))


OPEN = "select image_id, dimension, e, cross_probs from cross_levels join cross_raw using (image_id, dimension)"


@query("d12_score_from_logits", "cross_levels", f"""select image_id, dimension, {r(mos_sql('cross_probs'))} as score,
        {r(std_sql('cross_probs', 'm1'))} as std, {r('m2')} as open_score, {r(std_sql('e', 'm2'))} as open_std from w""",
       v=OPEN, w=f"select *, {mos_sql('cross_probs')} as m1, {mos_sql('e')} as m2 from v")
def d12(t):
    soft = lv.softmax_levels(F.col("logits"))
    open_set = lv.named_levels(F.transform_values("logits", lambda _, v: F.exp(v)))
    rows = t.cross.select(*KEYS, soft.alias("soft"), open_set.alias("open"))
    return rows.select(*KEYS, r6(lv.mos(F.col("soft"))).alias("score"), r6(lv.std(F.col("soft"))).alias("std"),
                       r6(lv.mos(F.col("open"))).alias("open_score"), r6(lv.std(F.col("open"))).alias("open_std"))


@query("d13_linear_fix", "cross_levels clamped", f"select image_id, dimension, {r('alpha')} as alpha, {r('(1e0 - alpha * a) / 5')} as beta from w",
       v=f"select image_id, dimension, m, list_sum(cross_probs) as a, {mos_sql('cross_probs')} as b from cross_levels join clamped using (image_id, dimension)",
       w="select image_id, dimension, round(a, 12) as a, (m - 3) / (round(b - 3e0 * a, 12) + 1e-9::double) as alpha from v")
def d13(t):
    rows = t.cross_levels.join(t.preds, list(KEYS))
    fix = rows.select(*KEYS, lv.linear_fix(F.col("cross_probs"), F.col("mu")).alias("fix"))
    return fix.select(*KEYS, r6("fix.alpha").alias("alpha"), r6("fix.beta").alias("beta"))


@query("d14_two_level_padded", "clamped", f"select image_id, dimension, {level_columns('p', digits=9)} from w",
       v="select *, least(greatest(ceil(mu - 1e-8::double) - 1, 1), 4)::double as c from clamped",
       w="""select image_id, dimension, list_transform([5e0,4e0,3e0,2e0,1e0], lambda v:
            case when v = c then (c + 1 + 1e-8::double - mu) / ((c + 1 + 1e-8::double) - (c - 1e-8::double))
                 when v = c + 1 then (mu - (c - 1e-8::double)) / ((c + 1 + 1e-8::double) - (c - 1e-8::double)) else 0e0 end) as p from v""")
def d14(t):
    return t.preds.select(*KEYS, lv.two_level_padded(F.col("mu")).alias("p")).select(*KEYS, *lv.columns(F.col("p"), digits=9))


TEN = f"select *, {gaussian_sql('m', 's', BINS_UP, BINS_DOWN)} as bins from clamped"
FOLDED = scaled_sql("[bins[10], bins[7]+bins[8]+bins[9], bins[5]+bins[6], bins[2]+bins[3]+bins[4], bins[1]]")


@query("d15_bins_to_levels", "clamped", f"select image_id, dimension, {level_columns('p')} from v", ten=TEN,
       v=f"select image_id, dimension, {FOLDED} as p from ten")
def d15(t):
    bins = t.preds.select(*KEYS, lv.gaussian_bins(F.col("mu"), F.col("sigma_sq")).alias("bins"))
    return bins.select(*KEYS, lv.bins_to_levels(F.col("bins")).alias("p")).select(*KEYS, *lv.columns(F.col("p")))


@query("d16_gaussian_bins", "clamped", "select image_id, dimension, "
       + ", ".join(f"{r(f'bins[{i}]')} as b{i}" for i in range(1, 11)) + " from ten", ten=TEN)
def d16(t):
    bins = t.preds.select(*KEYS, lv.gaussian_bins(F.col("mu"), F.col("sigma_sq")).alias("bins"))
    return bins.select(*KEYS, *[r6(F.element_at("bins", i)).alias(f"b{i}") for i in range(1, 11)])


FLOOR10 = lambda p: scaled_sql(f"list_transform({p}, lambda v: greatest(v, 1e-12::double))")


@query("d17_jsd_bins", "clamped cross_scores", f"""select image_id, dimension, {r('''0.5e0 * list_sum(list_transform(list_zip(a, b),
        lambda x: x[1] * ln(x[1] / (0.5e0 * (x[1] + x[2]))) + x[2] * ln(x[2] / (0.5e0 * (x[1] + x[2])))))''')} as jsd from w""",
       v=f"""select c.image_id, c.dimension, {gaussian_sql('m', 's', BINS_UP, BINS_DOWN)} as p,
            {gaussian_sql('score', 'half', BINS_UP, BINS_DOWN)} as q
            from clamped c join (select *, 0.5e0 as half from cross_scores) x using (image_id, dimension)""",
       w=f"select image_id, dimension, {FLOOR10('p')} as a, {FLOOR10('q')} as b from v")
def d17(t):
    joined = t.preds.join(t.cross_scores, list(KEYS)).select(
        *KEYS, lv.gaussian_bins(F.col("mu"), F.col("sigma_sq")).alias("p"),
        lv.gaussian_bins(F.col("score"), dbl(0.25)).alias("q"))
    return joined.select(*KEYS, r6(lv.jsd_bins(F.col("p"), F.col("q"))).alias("jsd"))


PANEL_BINS = f"select p.image_id, p.dimension, p.model, {gaussian_sql('score', 'half', BINS_UP, BINS_DOWN)} as bins from (select *, 0.5e0 as half from panel) p"
WIDE_RATERS = ("rater_af", "rater_nf", "rater_rf")


def bin_record_log(panel):
    """JSON lines of all raters: three write one record per image with all dimensions, three a
    flat record per image and dimension. Every seventh image of a flat record lacks its bins."""
    bins = gaussian_bins(0.25)
    entry = lambda d: F.struct(F.col(d).alias("score"), bins(F.col(d)).alias("probs"))
    image, wide, none = F.col("image_id").cast("string").alias("image"), F.col("model").isin(*WIDE_RATERS), F.lit(None).cast("array<double>")
    scores = F.inline(F.array(*[F.struct(F.lit(d).alias("dimension"), F.col(c).alias("score")) for d, c in (("overall", "overall"), ("sharpness", "sharpness"), ("colour", "color"))]))
    rows = panel.where(~wide).select("image_id", image, "model", scores)
    probs = F.when(F.col("image_id") % 7 > 0, bins(F.col("score"))).otherwise(none)
    flat = rows.select(F.to_json(F.struct("image", "model", "dimension", probs.alias("probs"), "score")).alias("line"))
    many = F.struct(image, "model", entry("overall").alias("overall"), entry("sharpness").alias("sharpness"), entry("color").alias("color_fidelity"))
    return flat.union(panel.where(wide).select(F.to_json(many).alias("line")))


@query("d18_bin_records", "panel", f"""select model, dimension, count(*) as n, {', '.join(r(f'avg(p[{i + 1}])') + f' as p{5 - i}' for i in range(5))}, {r('avg(' + mos_sql('p') + ')')} as mos from
        (select image_id, model, dimension, {FOLDED} as p from ten) where model in {WIDE_RATERS} or image_id % 7 > 0 group by 1, 2""", ten=PANEL_BINS)
def d18(t):
    """Bin records of all six raters in both layouts, folded to levels; told by rater and dimension."""
    rows = records.bin_records_to_levels(bin_record_log(t.panel_wide))
    return rows.groupBy("model", "dimension").agg(F.count(F.lit(1)).alias("n"), *[r6(F.avg(F.col("p")[i])).alias(f"p{5 - i}") for i in range(5)], r6(F.avg(lv.mos(F.col("p")))).alias("mos"))


@query("d18_bin_record_counts", "panel", f"""select model, sum(case when model in {WIDE_RATERS} then 1e0 / 3 else 1 end)::bigint as records, count(*) filter (model in {WIDE_RATERS} or image_id % 7 > 0) as rows,
        count(*) filter (model not in {WIDE_RATERS} and image_id % 7 = 0) as skipped from panel group by 1""")
def d18_counts(t):
    """Records read, rows made and records skipped per rater."""
    return records.bin_record_counts(bin_record_log(t.panel_wide))


@query("d19_gaussian_gaps", "clamped cross_levels", f"""select dimension, {r('avg(kl)')} as kl, {r('avg(js)')} as js, {r('avg(w2)')} as w2 from z group by 1""",
       v=f"""select c.*, s as s1, mm as m2, {std_sql('cross_probs', 'mm')} as s2 from clamped c join
            (select *, {mos_sql('cross_probs')} as mm from cross_levels) using (image_id, dimension)""",
       w="select *, 0.5e0 * (m + m2) as mid, sqrt(0.5e0 * (s1 * s1 + s2 * s2)) as sm from v",
       z="""select dimension, ln(s2 / (s1 + 1e-8::double)) + (s1 * s1 + (m - m2) * (m - m2)) / (2 * s2 * s2 + 1e-8::double) - 0.5e0 as kl,
            0.5e0 * (ln(sm / (s1 + 1e-8::double)) + (s1 * s1 + (m - mid) * (m - mid)) / (2 * sm * sm + 1e-8::double) - 0.5e0)
            + 0.5e0 * (ln(sm / (s2 + 1e-8::double)) + (s2 * s2 + (m2 - mid) * (m2 - mid)) / (2 * sm * sm + 1e-8::double) - 0.5e0) as js,
            sqrt((m - m2) * (m - m2) + (s1 - s2) * (s1 - s2)) as w2 from w""")
def d19(t):
    c = F.col
    rows = t.preds.join(t.cross_levels, list(KEYS)).select(
        "dimension", lv.clip(c("mu"), 1, 5).alias("m1"), lv.floored_sigma(c("sigma_sq")).alias("s1"),
        lv.mos(c("cross_probs")).alias("m2"), lv.std(c("cross_probs")).alias("s2"))
    args = (c("m1"), c("m2"), c("s1"), c("s2"))
    return rows.groupBy("dimension").agg(*[r6(F.avg(f(*args))).alias(n) for n, f in (
        ("kl", lv.gaussian_kl), ("js", lv.gaussian_js), ("w2", lv.gaussian_w2))])


@query("d20_level_text", "labelled", """select image_id, dimension,
        (['excellent', 'good', 'fair', 'poor', 'bad'])[list_position(p, list_max(p))] as level
        from (select image_id, dimension, list_transform(probs, lambda v: round(v, 9)) as p from labelled)""")
def d20(t):
    tidy = F.transform("probs", lambda v: F.round(v, 9))
    return t.labelled.select(*KEYS, lv.level_text(tidy).alias("level"))
