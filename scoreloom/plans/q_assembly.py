"""Sampling and training-table queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import levels as lv
from ..functions.numerics import dbl, r6
from ..operators import assembly as asm, ensemble as en, records as rc, uncertainty as un, versions as ver
from ..operators.ranking import attach_one
from ..operators.staging import fresh_path, staged
from ..sources.readers import last_per_key
from .oracle_views import LEVELS_DOWN, LEVELS_UP, VIEWS, gaussian_sql, h, level_columns, mos_sql, r, std_sql, two_level_sql
from .q_ensemble import consensus_rows
from .q_sources import human_records, machine_records, paths
from .q_stats import BUCKET, level_gate, union_with_defaults
from .q_uncertainty import Parts
from .registry import query

KEYS = ["image_id", "dimension"]
H42 = lambda key="image_id": h("'42'", key)


@query("x1_holdout_split", "truth_wide", """select image_id, source, case when pos <= greatest(1, floor(n * 0.1e0)) then 'holdout' else 'train' end as part from (
        select *, row_number() over (partition by source order by k, image_id) as pos, count(*) over (partition by source) as n from (select *, """ + H42() + " as k from truth_wide))")
def x1(t):
    return asm.holdout_split(t.truth_wide.select("image_id", "source"), "image_id").select("image_id", "source", "part")


TW = "truth_wide"


@query("x2_bases_stride", TW, """select image_id from (select image_id, row_number() over (order by image_id) - 1 as i, count(*) over () as n from truth_wide)
        where i % floor(n / least(350, n))::bigint = 0 and i / floor(n / least(350, n)) < 350""")
def x2a(t):
    return asm.select_bases(t.truth_wide.select("image_id", "overall"), "overall", "image_id", 350).select("image_id")


@query("x2_bases_highest", TW, f"select image_id, {r('overall')} as gt from (select * from truth_wide order by overall desc, image_id limit 350)")
def x2b(t):
    return asm.select_bases(t.truth_wide.select("image_id", "overall"), "overall", "image_id", 350, "highest_quality").select("image_id", r6("overall").alias("gt"))


@query("x2_bases_stratified", TW, """select image_id from p where pos <= 87 union all select image_id from (select image_id, row_number() over (order by pos, bin, image_id) as q from p where pos > 87)
        where q <= 350 - (select count(*) from p where pos <= 87)""",
       p=f"select image_id, bin, row_number() over (partition by bin order by {H42()}, image_id) as pos from (select image_id, least(floor(overall - 1), 3) as bin from truth_wide)")
def x2c(t):
    return asm.select_bases(t.truth_wide.select("image_id", "overall"), "overall", "image_id", 350, "stratified").select("image_id")


def _tier_case():
    out, ends = "case", []
    for name, share in asm.TIER_SHARES.items():
        ends.append(f"round_even(n * {share!r}::double, 0)")
        out += f" when pos <= {' + '.join(ends)} then '{name}'"
    return out + " else 'moderate' end"


@query("x3_tier_plan", TW, f"select image_id, {_tier_case()} as tier from (select image_id, row_number() over (order by {H42()}, image_id) as pos, count(*) over () as n from truth_wide)")
def x3(t):
    return asm.plan_tiers(t.truth_wide.select("image_id"), "image_id").select("image_id", "tier")


@query("x4_per_bucket", "truth_wide sacred", f"""select image_id, bucket from (select image_id, bucket, row_number() over (partition by bucket order by {H42()}, image_id) as pos
        from (select image_id, {BUCKET('overall')} as bucket from truth_wide where image_id not in (from sacred))) where pos <= 40""")
def x4(t):
    rows = t.truth_wide.select("image_id", rc.quality_bucket(F.col("overall")).alias("bucket"))
    return asm.per_bucket(rows, "bucket", "image_id", 40, exclude=Parts(t).sacred).select("image_id", "bucket")


@query("x5_per_source", "", f"select doc_id, source from (select doc_id, source, row_number() over (partition by source order by {H42('doc_id')}, doc_id) as pos from documents) where pos <= 30")
def x5(t):
    return asm.per_bucket(t.raw("documents").select("doc_id", "source"), "source", "doc_id", 30)


@query("x6_resample_exact", TW, f"""select slot, image_id from (select slot, case when slot <= n then slot else {h("'42'", 'slot')} % n + 1 end as pos
        from (select n, unnest(range(1, n + n // 2 + 1)) as slot from (select count(*) as n from truth_wide))) join
        (select image_id, row_number() over (order by {H42()}, image_id) as pos from truth_wide) using (pos)""")
def x6(t):
    return asm.resample_exact(t.truth_wide.select("image_id"), "image_id", F.col("n") + F.floor(F.col("n") / 2)).select("slot", "image_id")


@query("x7_repeat_rows", "base", "select image_id, unnest(range(1, n_lines + 1))::int as copy from base")
def x7(t):
    return asm.repeat_rows(t.base.select("image_id", "n_lines"), F.col("n_lines")).select("image_id", "copy")


@query("x8_mixed_training", "truth_wide cross_scores", f"""select image_id, 'truth' as origin, {r('(overall - 1) / 4')} as target, 1e0 as sample_weight from truth_wide
        union all select image_id, 'pseudo', {r('(score - 1) / 4')}, 0.5e0 from (select c.*, n_lines from cross_scores c join cross_units using (image_id)) where dimension = 'overall' and n_lines / 8e0 >= 0.3""")
def x8(t):
    truth = t.truth_wide.select("image_id", F.col("overall").alias("score"))
    seen = t.raw("lineitem").where("l_returnflag <> 'A'").groupBy(F.col("l_orderkey").alias("image_id")).agg((F.count(F.lit(1)) / dbl(8)).alias("confidence"))
    pseudo = t.cross_scores.where("dimension = 'overall'").join(seen, "image_id").select("image_id", "score", "confidence")
    mixed = asm.mix(truth, pseudo, 0.3)
    return asm.rows_of_epoch(mixed, 0).select("image_id", "origin", r6((F.col("score") - 1) / 4).alias("target"), "sample_weight")


@query("x9_quota_sample", "", f"""select doc_id, lang from (select doc_id, lang, row_number() over (partition by lang order by {H42('doc_id')}, doc_id) as pos, na, nb from d, s)
        where pos <= case when lang = 'en' then case when na >= 300 and nb < 300 then least(600 - nb, na) else least(300, na) end
        else case when na < 300 then least(600 - na, nb) else least(300, nb) end end""",
       d="select * from documents where n_chars >= 50 and lang in ('en', 'fr')", s="select count(*) filter (lang = 'en') as na, count(*) filter (lang = 'fr') as nb from d")
def x9(t):
    docs = t.raw("documents").where("n_chars >= 50").select("doc_id", "lang")
    return asm.quota_sample(docs, "lang", "doc_id", {"en": 300, "fr": 300})


VIEWS["annotated"] = ("spreads truth_wide spread_cut", "select image_id, spread, overall as mos, category, (case when spread > q99 then 2 when spread > q90 then 1 else 0 end)::int as ood from spreads join truth_wide using (image_id), spread_cut")


def annotated(t):
    spreads = Parts(t).spreads
    rows = attach_one(spreads, un.spread_baseline(spreads), "soft_threshold", "hard_threshold")
    rows = rows.withColumn("ood", un.ood_category(F.col("spread"), F.col("soft_threshold"), F.col("hard_threshold")))
    return staged(rows.join(t.truth_wide.select("image_id", F.col("overall").alias("mos"), "category"), "image_id").select("image_id", "spread", "mos", "category", "ood"), "annotated")


VIEWS["anchor_pool"] = ("annotated", """select * from (select *, row_number() over (partition by target order by d, image_id) as near, count(*) filter (d <= 0.3) over (partition by target) as found
    from (select *, abs(mos - target) as d from annotated, (select unnest([1e0,2e0,3e0,4e0,5e0]) as target))) where d <= 0.3 or (found = 0 and near <= 20)""")
VIEWS["anchor_ends"] = ("anchor_pool", "select *, max(spread) over (partition by target) as ms, greatest(max(d) over (partition by target), 1e-8) as md from anchor_pool")
VIEWS["anchors"] = ("anchor_ends", "select target, image_id, mos, spread from (select *, row_number() over (partition by target order by round(spread / ms * 0.5e0 + d / md * 0.5e0, 9), image_id) as rk from anchor_ends) where rk = 1")


@query("x10_anchors", "anchors", f"select target, image_id, {r('mos')} as mos, {r('spread', 9)} as spread from anchors")
def x10(t):
    return asm.pick_anchors(annotated(t), "mos", "spread", "image_id").select("target", "image_id", r6("mos").alias("mos"), r6("spread", 9).alias("spread"))


VIEWS["picks"] = ("annotated", """select image_id, spread, category, ood from (select *, row_number() over (partition by ood order by category, pos) as o, case ood when 0 then 5 else 10 end as want from (
        select *, greatest(1, floor(least(case ood when 0 then 5 else 10 end, n) / cats))::bigint as k0 from (select *, row_number() over (partition by ood, category order by spread, image_id) as pos,
        count(*) over (partition by ood, category) as c, count(*) over (partition by ood) as n, m.cats from annotated join (select ood, count(distinct category) as cats from annotated group by 1) m using (ood)))
        where len(list_filter(range(0, least(k0, c)), lambda i: floor(case when least(k0, c) > 1 then i * (c - 1) / (least(k0, c) - 1) else 0 end) = pos - 1)) > 0) where o <= want""")


@query("x11_stratified_pick", "picks", f"select image_id, {r('spread', 9)} as spread, category, ood from picks")
def x11(t):
    return asm.stratified_pick(annotated(t), "spread", "ood", "category", "image_id").select("image_id", r6("spread", 9).alias("spread"), "category", "ood")


@query("x12_annotation_batch", "picks anchors", f"select image_id, is_anchor, annotation_stratum, known_mos, row_number() over (order by {h(repr('42'), 'image_id', 'case when is_anchor then $$true$$ else $$false$$ end')}, image_id)::int as presentation_order from b",
       b=f"""select image_id, false as is_anchor, case ood when 0 then 'low_spread_sanity_check' when 1 then 'medium_spread_boundary' else 'high_spread_diagnostic' end as annotation_stratum, null::double as known_mos from picks
            union all select image_id, true, 'anchor', {r('mos')} from anchors""")
def x12(t):
    rows = annotated(t)
    batch = asm.annotation_batch(asm.stratified_pick(rows, "spread", "ood", "category", "image_id"), asm.pick_anchors(rows, "mos", "spread", "image_id"), "image_id")
    return batch.select("image_id", "is_anchor", "annotation_stratum", r6("known_mos").alias("known_mos"), "presentation_order")


@query("x13_rater_processing", "scored truth_wide", f"""select image_id, dimension, {r('mos')} as mos, {r('sd')} as mos_std, {r('mos * a + b')} as calibrated, coalesce(sd > 1, false) as high_variance from m join l using (dimension)""",
       an="select image_id, dimension, max(gt) as known from scored where category = '1-URGENT' group by 1, 2",
       dr="select model from scored join an using (image_id, dimension) group by model, dimension having count(*) >= 3 and stddev_pop(score - known) > 1.045",
       m="select image_id, dimension, avg(score) as mos, stddev_samp(score) as sd from panel where model not in (from dr) group by 1, 2",
       l="select dimension, regr_slope(known, mos) as a, regr_intercept(known, mos) as b from m join an using (image_id, dimension) group by 1")
def x13(t):
    from .q_ensemble import scored

    rows = scored(t)
    anchors = rows.where(F.col("category") == "1-URGENT").groupBy(*KEYS).agg(F.max("gt").alias("known_mos"))
    done = asm.process_raters(t.panel.withColumnRenamed("model", "rater"), anchors, 1.045)
    return done.select(*KEYS, r6("mos").alias("mos"), r6("mos_std").alias("mos_std"), r6("calibrated").alias("calibrated"), "high_variance")


SEV = {e: f"(1e0 - hi) + ({h(repr(e), 'seed')} % 1000000) / 1000000e0 * (hi - lo)" for e in asm.EFFECTS}


@query("x14_degradation_plan", TW, f"select image_id, tier, profile, seed, lo as quality_low, hi as quality_high, {', '.join(f'{r(e, 9)} as {e}' for e in asm.EFFECTS)}, {r('greatest(0e0, 1e0 - greatest(' + ', '.join(asm.EFFECTS) + '))', 9)} as overall_quality from s",
       tiers=" union all ".join(f"select {i} as ti, '{a}' as tier, '{p}' as profile, {lo}::double as lo, {hi}::double as hi" for i, (a, p, lo, hi) in enumerate(asm.DEGRADATIONS)),
       w="select image_id, tier, profile, lo, hi, 20000 + image_id * 100 + ti as seed from truth_wide, tiers", s="select *, " + ", ".join(f"{v} as {k}" for k, v in SEV.items()) + " from w")
def x14(t):
    plan = asm.degradation_plan(t.truth_wide.select("image_id"), "image_id")
    return plan.select("image_id", "tier", "profile", "seed", "quality_low", "quality_high", *[r6(e, 9).alias(e) for e in (*asm.EFFECTS, "overall_quality")])


QUESTION_LIST = "[" + ", ".join("'" + q.replace("'", "''") + "'" for q in asm.QUESTIONS) + "]"
LEVEL_LIST = "['excellent', 'good', 'fair', 'poor', 'bad']"
ASK = lambda key="image_id": f"({QUESTION_LIST})[{h(repr('42'), key)} % 10 + 1]"
REPLY = lambda p: f"'The ' || case dimension when 'sharpness' then 'sharpness' when 'color' then 'color_fidelity' else 'quality' end || ' of the image is ' || ({LEVEL_LIST})[list_position(list_transform({p}, lambda v: round(v, 6)), list_max(list_transform({p}, lambda v: round(v, 6))))] || '.'"


def flat(records):
    """Training records with their nested parts as plain columns."""
    turn = lambda i: F.col("conversations")[i]["value"]
    return records.select("id", "image", (F.col("gt_score") + dbl(0)).alias("gt_score"), (F.col("std") + dbl(0)).alias("std"), turn(0).alias("ask"), turn(1).alias("reply"), "pseudo_label",
                          (F.col("confidence_weight") + dbl(0)).alias("confidence_weight"), "source_tier", *lv.columns(F.col("level_probs"), "p", 6))


def record_sql(source, prefix, weight, tier, pseudo, image="image_id::varchar"):
    return f"""select '{prefix}' || dimension || '_' || image_id as id, {image} as image, {r(mos_sql('probs'), 4)} as gt_score, {r(std_sql('probs', mos_sql('probs')), 4)} as std,
        {ASK()} || chr(10) || '<|image|>' as ask, {REPLY('probs')} as reply, {pseudo} as pseudo_label, {r(weight, 4)} as confidence_weight, {tier} as source_tier, {level_columns('probs')} from {source}"""


@query("p17_templates", "labelled", f"select image_id, dimension, {ASK()} as ask, {REPLY('probs')} as reply from labelled")
def p17(t):
    tidy = F.transform("probs", lambda v: F.round(v, 6))
    return t.labelled.select(*KEYS, asm.question(42, F.col("image_id")).alias("ask"), asm.answer(F.col("dimension"), tidy).alias("reply"))


@query("x15_quality_to_record", "base", record_sql("l", "", "0.7e0", "'deterministic'", "true"),
       m="select image_id, 'overall' as dimension, 1e0 + 4e0 * q as m, 0.8e0 as s from base", l=f"select *, {gaussian_sql('m', 's', LEVELS_UP, LEVELS_DOWN)} as probs from m")
def x15(t):
    mos = rc.quality_to_mos(F.col("q"))
    rows = t.base.select("image_id", F.lit("overall").alias("dimension"), lv.gaussian_levels(mos, dbl(0.8)).alias("probs"), dbl(0.7).alias("weight"), F.lit("deterministic").alias("tier"))
    return flat(asm.training_record(rows, "", True))


@query("x16_consensus_to_record", "consensus", f"select t.* exclude (raw_mos, raw_std), {r('raw_mos')} as raw_mos, {r('raw_std')} as raw_std from ({record_sql('l', 'vlm_', '0.5e0', chr(39) + 'consensus' + chr(39), 'true').replace(' from l', ', mos as raw_mos, std0 as raw_std from l')}) t",
       m="select image_id, dimension, mos, std as std0, greatest(1e0, least(5e0, mos)) as m, greatest(std, 0.1e0) as s from consensus where mos is not null", l=f"select *, {gaussian_sql('m', 's', LEVELS_UP, LEVELS_DOWN)} as probs from m")
def x16(t):
    good = consensus_rows(t).where(F.col("mos").isNotNull()).select(*KEYS, lv.gaussian_levels(F.col("mos"), F.col("std")).alias("probs"), dbl(0.5).alias("weight"), F.lit("consensus").alias("tier"), "mos", "std")
    good = staged(good, "consensus")
    raw = good.select(F.concat_ws("_", F.lit("vlm"), "dimension", F.col("image_id").cast("string")).alias("id"), r6("mos").alias("raw_mos"), r6("std").alias("raw_std"))
    return flat(asm.training_record(good, "vlm", True)).join(raw, "id")


@query("x17_accepted_to_record", "vetoed_rows", record_sql("(select * from vetoed_rows where final_weight >= 0.3 and tier <> 'hard_reject' and not vetoed)", "pseudo_", "final_weight", "tier", "true", "'img/' || image_id"))
def x17(t):
    return flat(asm.training_record(un.accepted(Parts(t).vetoed), "pseudo", True, "img"))


@query("x18_master_to_record", "merged", f"""select case when overall_source = 'human' then '' else 'pseudo_' end || 'overall_' || image_id as id, {r('overall_mos', 4)} as gt_score,
        case when overall_source = 'human' then 1e0 else 0.5e0 end as confidence_weight, case when overall_source = 'human' then 'human' else 'low_weight' end as source_tier, overall_source <> 'human' as pseudo_label, {ASK()} as ask from merged""")
def x18(t):
    from ..operators import joins as jn

    return master_to_training(jn.merge_records(human_records(t), machine_records(t)), "overall")


def master_to_training(master, dimension, min_weight=0.3, seed=42):
    """Training rows of one dimension: human labels weigh 1, machine labels below the limit are dropped."""
    d = F.try_element_at("dimensions", F.lit(dimension))
    rows = master.where(d.isNotNull()).withColumn("d", d)
    human = F.col("d.label_source") == "human"
    weight = F.coalesce("d.acceptance", dbl(1))
    return rows.where(human | (weight >= min_weight)).select(
        F.concat(F.when(human, "").otherwise("pseudo_"), F.lit(f"{dimension}_"), F.col("canonical_id").cast("string")).alias("id"), r6("d.mos", 4).alias("gt_score"),
        F.round(weight, 4).alias("confidence_weight"), F.when(F.col("d.acceptance").isNull(), "human").otherwise("low_weight").alias("source_tier"), (~human).alias("pseudo_label"),
        asm.question(seed, F.col("canonical_id")).alias("ask"))


@query("x19_human_to_master", "paths truth_wide", f"""select lpad(image_id::varchar, 7, '0') as canonical_id, p.split, path, nullif(replace(replace(path, '/res/', '/ori/'), '_res_', '_ori_'), path) as ori,
        case when p.split = 'test' then 0 else 3 end as n_dimensions, case when p.split <> 'test' then {r('overall')} end as mos from paths p join truth_wide using (image_id)""")
def x19(t):
    """Human rows as master records; test rows come from the manifest without labels."""
    rows = paths(t).join(t.truth_wide.select("image_id", "overall", "sharpness", "color"), "image_id")
    dims = F.map_from_arrays(F.array(*[F.lit(d) for d in ("overall", "sharpness", "color")]), F.array("overall", "sharpness", "color"))
    empty = F.create_map().cast("map<string,double>")
    master = rows.select(rc.canonical_id(F.col("path")).alias("canonical_id"), rc.split_from_path(F.col("path")).alias("split"), "path", rc.sibling_path(F.col("path")).alias("ori"),
                         F.when(rc.split_from_path(F.col("path")) == "test", empty).otherwise(dims).alias("dimensions"))
    return master.select("canonical_id", "split", "path", "ori", F.size("dimensions").alias("n_dimensions"), r6(F.try_element_at("dimensions", F.lit("overall"))).alias("mos"))


@query("x20_accepted_to_master", "vetoed_rows", f"""select image_id, count(*) as n_dimensions, {r('max(final_weight)', 9)} as max_weight, bool_or(vetoed) as any_veto, {r('max(spread)', 9)} as spread from vetoed_rows where tier <> 'hard_reject' group by 1""")
def x20(t):
    """Machine labels as master records: nested provenance per dimension, spread signals kept."""
    rows = Parts(t).vetoed.where(F.col("tier") != un.REJECT)
    signals = F.struct("distance", "jsd", "sigma_sq", "entropy", "spread", "cluster_divergence", "n_spread_models")
    rec = F.struct(F.lit("pseudo_label").alias("label_source"), F.transform("probs", lambda v: F.round(v, 6)).alias("level_probs"), F.round("mos", 4).alias("mos"), F.round("std", 4).alias("std"),
                   F.struct("tier", "weight", "reason", signals.alias("signals")).alias("acceptance"), "vetoed")
    master = rows.groupBy("image_id").agg(F.map_from_entries(F.collect_list(F.struct("dimension", rec))).alias("dimensions"))
    vals = F.map_values("dimensions")
    return master.select("image_id", F.size("dimensions").cast("long").alias("n_dimensions"), r6(F.array_max(F.transform(vals, lambda d: d["acceptance"]["weight"])), 9).alias("max_weight"),
                         F.exists(vals, lambda d: d["vetoed"]).alias("any_veto"), r6(F.array_max(F.transform(vals, lambda d: d["acceptance"]["signals"]["spread"])), 9).alias("spread"))


@query("x21_ratings_per_image", "ratings", f"select image_id, count(*) as n, count(*) filter (error <> '') as n_errors, {r('arg_min(score, ord)')} as first_score from v group by 1",
       v="select * from (select *, row_number() over (partition by model_id, image_id, arm order by ord desc) as rn from ratings) where rn = 1")
def x21(t):
    """Latest answer of every model and arm per image, as one list per image (bounded by models x arms)."""
    latest = last_per_key(t.ratings.select("model_id", "image_id", "arm", "ord", "score", "error"), ["model_id", "image_id", "arm"], "ord")
    lists = latest.groupBy("image_id").agg(F.array_sort(F.collect_list(F.struct("ord", "model_id", "arm", "score", "error"))).alias("evals"))
    return lists.select("image_id", F.size("evals").cast("long").alias("n"), F.size(F.filter("evals", lambda e: e["error"] != "")).cast("long").alias("n_errors"), r6(F.col("evals")[0]["score"]).alias("first_score"))


VIEWS["mos_table"] = ("truth_wide", "select image_id, split, overall as mos, 0.05e0 + 0.3e0 * abs(sharpness - color) as sd from truth_wide")
PDF = "list_transform([5e0,4e0,3e0,2e0,1e0], lambda v: exp(0e0 - ((v - mn) / sn) * ((v - mn) / sn) / 2) / (sn * sqrt(2 * pi())))"
VIEWS["soft0"] = ("mos_table", f"select *, {PDF} as po from (select *, 4 * (mos - lo) / (hi - lo) + 1 as mn, 4 * sd / (hi - lo) as sn from mos_table, (select min(mos) as lo, max(mos) as hi from mos_table))")
VIEWS["soft1"] = ("soft0", f"select *, (1e0 - al * list_sum(po)) / 5 as be from (select *, (mn - 3) / ({mos_sql('po')} - 3e0 * list_sum(po) + 1e-9::double) as al from soft0)")
VIEWS["soft2"] = ("soft1", "select *, list_transform(po, lambda v: greatest(v * al + be, 0e0)) as fx, least(greatest(ceil(mn - 1e-8::double) - 1, 1), 4)::double as c from soft1")
TWO = """list_transform([5e0,4e0,3e0,2e0,1e0], lambda v: case when v = c then (c + 1 + 1e-8::double - mn) / ((c + 1 + 1e-8::double) - (c - 1e-8::double))
    when v = c + 1 then (mn - (c - 1e-8::double)) / ((c + 1 + 1e-8::double) - (c - 1e-8::double)) else 0e0 end)"""
VIEWS["soft3"] = ("soft2", f"select *, (sn < 0.2 or abs({mos_sql('fx')} - mn) > 0.1) as two from soft2")
VIEWS["soft"] = ("soft3", f"""select image_id, split, mn, sn, two, p as probs, abs({mos_sql('po')} - mn) as raw_gap, abs({mos_sql('p')} - mn) as gap, case when two then 1e0 else al end as alpha,
    case when two then 0e0 else be end as beta from (select *, case when two then {TWO} else fx end as p from soft3)""")


def soft(t):
    table = t.truth_wide.select("image_id", "split", F.col("overall").alias("mos"), (dbl(0.05) + dbl(0.3) * F.abs(F.col("sharpness") - F.col("color"))).alias("sd"))
    return asm.soft_labels(table, "mos", "sd")


@query("x22_soft_labels", "soft", f"select image_id, split, {r('mn')} as mos_norm, two as is_two_level, {level_columns('probs')} from soft where split in ('train', 'test')")
def x22(t):
    return soft(t).where(F.col("split").isin("train", "test")).select("image_id", "split", r6("mos_norm").alias("mos_norm"), "is_two_level", *lv.columns(F.col("probs")))


SOFT_IMAGE, SOFT_TEXT = "'scans/' || image_id || '.png'", "cast(cast(round({}, 3) as decimal(6,3)) as varchar)"


@query("x22_soft_label_records", "soft", f"""select split, image_id || '.png->' || {SOFT_TEXT.format('mos')} as id, {SOFT_IMAGE} as image, {r('mos')} as gt_score, {r('mn')} as gt_score_norm, {r('sd')} as std, {r('sn')} as std_norm,
        case when split = 'train' then {ASK(SOFT_IMAGE)} || chr(10) || '<|image|>' end as ask,
        case when split = 'train' then 'The quality of the image is ' || (['bad', 'poor', 'fair', 'good', 'excellent'])[least(greatest(ceil((mn - 1e-8::double - 1) / 0.8), 1), 5)::int] || '.' end as reply,
        case when split = 'train' then {r('list_sum(po)')} end as mass_org, case when split = 'train' then {r(mos_sql('probs'))} end as mos_of_probs
        from soft join (select image_id, mos, sd, po from soft0) using (image_id) where split in ('train', 'test')""")
def x22_records(t):
    rows = soft(t).withColumns({"file": F.concat(F.lit("scans/"), F.col("image_id").cast("string"), F.lit(".png")), "mos_text": F.round("mos", 3).cast("decimal(6,3)").cast("string")})
    out = asm.soft_label_records(rows, "file", "mos", "sd", "mos_text")
    mass = F.aggregate("level_probs_org", dbl(0), lambda a, v: a + v)
    return out.select("split", "id", "image", *[r6(c).alias(c) for c in ("gt_score", "gt_score_norm", "std", "std_norm")], F.col("conversations")[0]["value"].alias("ask"),
                      F.col("conversations")[1]["value"].alias("reply"), r6(mass).alias("mass_org"), r6(lv.mos(F.col("level_probs"))).alias("mos_of_probs"))


REPORT = ("raw_l1", "raw_l2", "l1", "l2", "alpha_mean", "alpha_std", "beta_mean", "beta_std", "two_level_share")


@query("a32_soft_label_report", "soft", f"""select count(*) as n, {r('avg(raw_gap)')} as raw_l1, {r('sqrt(avg(raw_gap * raw_gap))')} as raw_l2, {r('avg(gap)')} as l1, {r('sqrt(avg(gap * gap))')} as l2, {r('avg(alpha)')} as alpha_mean,
        {r('stddev_pop(alpha)')} as alpha_std, {r('avg(beta)')} as beta_mean, {r('stddev_pop(beta)')} as beta_std, {r('avg(two::int)')} as two_level_share from soft where split in ('train', 'test')""")
def a32(t):
    return asm.soft_label_report(soft(t).where(F.col("split").isin("train", "test"))).select("n", *[r6(c).alias(c) for c in REPORT])


@query("x23_two_level_labels", "truth", f"select image_id, dimension, level, {level_columns('p', digits=8)} from (select *, {TWO.replace('mn', 'gt')} as p from v)",
       v="""select t.*, least(greatest(ceil(gt - 1e-8::double) - 1, 1), 4)::double as c, (case when gt <= lo + 0.2e0 * (hi - lo) + 1e-8 then 1 when gt <= lo + 0.4e0 * (hi - lo) + 1e-8 then 2
            when gt <= lo + 0.6e0 * (hi - lo) + 1e-8 then 3 when gt <= lo + 0.8e0 * (hi - lo) + 1e-8 then 4 else 5 end)::int as level from truth t
            join (select dimension, min(gt) as lo, max(gt) as hi from truth group by 1) using (dimension)""")
def x23(t):
    ends = t.truth.groupBy("dimension").agg(F.min("gt").alias("lo"), F.max("gt").alias("hi"))
    rows = t.truth.join(ends, "dimension").select(*KEYS, rc.equal_width_level(F.col("gt"), F.col("lo"), F.col("hi")).alias("level"), lv.two_level_padded(F.col("gt")).alias("p"))
    return rows.select(*KEYS, "level", *lv.columns(F.col("p"), digits=8))


X24 = """select image_id, source, mos, weight, case when pos <= greatest(1, floor(n * 0.1e0)) then 'holdout' else 'train' end as part from (select *, row_number() over (partition by source order by k, image_id) as pos,
    count(*) over (partition by source) as n from (select image_id, 'degraded' as source, 1e0 + 4e0 * q as mos, 0.7e0 as weight, """ + H42() + """ as k from base union all
    select image_id, 'consensus', mos, 0.5e0, """ + H42() + " from consensus where dimension = 'overall' and mos is not null))"


VERSION = dict(ex=X24, rows="select image_id, part, source, mos, weight from ex union all select image_id, 'train', 'human', overall, 1e0 from truth_wide",
               v="select *, greatest(1e0, least(5e0, mos)) as m from rows", levels=f"select *, {two_level_sql('m')} as p from v")


def version_of(t):
    """Human rows and two expansion streams as a published version; returns where it is."""
    c = F.col
    def layout(df, source, stream, method, mos, weight, cost):
        return df.select("image_id", mos.alias("mos"), lv.two_level(mos).alias("level_probs"), F.lit(source).alias("source"), F.lit(stream).alias("stream"), F.lit(method).alias("label_method"), dbl(weight).alias("weight"), dbl(cost).alias("cost"))

    a = layout(t.base, "degraded", "stream1", "deterministic", rc.quality_to_mos(c("q")), 0.7, 0)
    b = layout(consensus_rows(t).where((c("dimension") == "overall") & c("mos").isNotNull()).select("image_id", c("mos").alias("_mos")), "consensus", "stream3", "consensus", c("_mos"), 0.5, 0.004)
    human = layout(t.truth_wide, "human", "base", "human", c("overall"), 1.0, 0)
    root = fresh_path(t.spark, "versions")
    return root, ver.build_version(root, "set_1", human, [a, b], parent="set_0", level_mass_min=0.005)


@query("x24_versioned_build", "base consensus truth_wide", f"select part, source, count(*) as n, {r('avg(mos)')} as mean_mos, {r('avg(weight)')} as mean_weight from rows group by 1, 2", **VERSION)
def x24(t):
    """Expansion streams, holdout per source, merge with human rows, level gate, publication; the published rows per part and source."""
    root, _ = version_of(t)
    rows = ver.read_version(t.spark, root, "set_1")
    return rows.groupBy("part", "source").agg(F.count(F.lit(1)).alias("n"), r6(F.avg("mos")).alias("mean_mos"), r6(F.avg("weight")).alias("mean_weight"))


SHARES = ("excellent_pct", "good_pct", "fair_pct", "poor_pct", "bad_pct", "mos_mean", "mos_std", "mos_min", "mos_max")
RANGES = ("mos >= 4.5", "mos >= 3.5 and mos < 4.5", "mos >= 2.5 and mos < 3.5", "mos >= 1.5 and mos < 2.5", "mos < 1.5")


@query("x24_manifest", "base consensus truth_wide", "select " + ", ".join(f"{r(f'avg(({c})::int) * 100')} as {n}" for n, c in zip(SHARES, RANGES)) + f""", {r('avg(mos)')} as mos_mean, {r('stddev_pop(mos)')} as mos_std, {r('min(mos)')} as mos_min, {r('max(mos)')} as mos_max,
        count(*) as total_samples, count(*) filter (source <> 'human') as new_samples, (select count(*) from rows where part = 'holdout') as holdout_samples, {', '.join(r(f'sum(p[{i}]) / sum(list_sum(p))') + f' as level_{6 - i}' for i in range(1, 6))},
        {r("sum(case when source = 'consensus' then 0.004e0 else 0e0 end)", 3)} as cost, count(distinct source) as n_sources, true as gate from levels where part = 'train'""", **VERSION)
def x24_manifest(t):
    """The manifest of that version: gate, new rows against all, holdout, quality distribution, cost."""
    root, _ = version_of(t)
    m = ver.read_manifest(t.spark, root, "set_1")
    facts = {**m["quality_distribution"], **{k: m[k] for k in ("total_samples", "new_samples", "holdout_samples")}, **{f"level_{5 - i}": s for i, s in enumerate(m["level_shares"])}}
    row = {**{k: round(v, 6) if isinstance(v, float) else v for k, v in facts.items()}, "cost": round(m["cost"], 3), "n_sources": len(m["sources"]), "gate": m["validation_gates"]["level_gate_passed"]}
    return t.spark.createDataFrame([tuple(row.values())], ", ".join(f"{k} {'boolean' if isinstance(v, bool) else 'long' if isinstance(v, int) else 'double'}" for k, v in row.items()))


@query("j18_random_partner", TW, f"""select a.image_id, a.source, b.image_id as partner from n a join n b on a.source = b.source and b.i = (a.i + {h(repr('42'), 'a.image_id')} % (a.n - 1) + 1) % a.n where a.n > 1""",
       n="select image_id, source, row_number() over (partition by source order by image_id) - 1 as i, count(*) over (partition by source) as n from truth_wide")
def j18(t):
    return asm.random_partner(t.truth_wide.select("image_id", "source"), "image_id", "source").select("image_id", "source", "partner")
