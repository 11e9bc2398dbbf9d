"""Source, sink, parsing and record-join queries (S, P, part of J)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import levels as lv
from ..functions.numerics import dbl, key_hash, r6
from ..operators import joins as jn, records as rc
from ..operators.ranking import attach_one
from ..operators.staging import fresh_path, staged
from ..sources import readers as rd, writers as wr
from .oracle_views import VIEWS, gaussian_sql, h, level_columns, mos_sql, r, std_sql
from .q_stats import BUCKET
from .registry import query

KEYS = ["image_id", "dimension"]
RATING = "ord bigint, model_id string, image_id bigint, score double, latency_ms bigint, arm string, error string"


def rating_lines(t, by_file=False):
    """The rating log as JSON lines, in log order across files."""
    path = fresh_path(t.spark, "ratings")
    rows = t.ratings.repartitionByRange("ord").sortWithinPartitions("ord")
    if by_file:
        named = rows.withColumn("file", F.concat(F.replace("model_id", F.lit("_"), F.lit("__")), F.lit(".jsonl"))).drop("model_id")
        named.write.partitionBy("file").json(path)
    else:
        rows.write.json(path)
    return path


@query("s1_jsonl_scan", "ratings", f"select ord, model_id, image_id, {r('score')} as score, error from ratings")
def s1(t):
    rows = rd.read_jsonl(t.spark, rating_lines(t), RATING)
    return rows.select("ord", "model_id", "image_id", r6("score").alias("score"), "error")


@query("s2_last_line_wins", "ratings", f"select model_id, image_id, max(ord) as ord, {r('arg_max(score, ord)')} as score from ratings group by 1, 2")
def s2(t):
    return rd.read_last_per_key(t.spark, rating_lines(t), RATING, ["model_id", "image_id"]).select("model_id", "image_id", "ord", r6("score").alias("score"))


@query("s3_json_arrays", "truth", f"select image_id, dimension, {r('gt')} as gt from truth")
def s3(t):
    """One file of a JSON array per dimension: small hand-written exports, so one array per image block."""
    paths = {}
    for d in ("overall", "sharpness", "color"):
        rows = t.truth.where(F.col("dimension") == d).select("image_id", "gt")
        # Arrays of bounded length, one per line: a reader never meets an endless array.
        arrays = rows.groupBy((F.col("image_id") / 1000).cast("long").alias("b")).agg(F.to_json(F.collect_list(F.struct("image_id", "gt"))).alias("value"))
        paths[d] = fresh_path(t.spark, f"array-{d}")
        arrays.select("value").repartition(F.col("value")).write.option("maxRecordsPerFile", 1).text(paths[d])
    rows = rd.read_dimension_arrays(t.spark, paths, "image_id bigint, gt double")
    return rows.select(*KEYS, r6("gt").alias("gt"))


@query("s4_csv_grades", "truth_wide", f"select 'img/res_' || image_id as res, 'img/ori_' || image_id as ori, {r('overall')} as overall, {r('sharpness')} as sharpness, {r('color')} as color_fidelity from truth_wide")
def s4(t):
    path = fresh_path(t.spark, "grades")
    tag = lambda x: F.concat(F.lit(f"img/{x}_"), F.col("image_id").cast("string"))
    t.truth_wide.select(tag("res").alias("res"), tag("ori").alias("ori"), "overall", "sharpness", F.col("color").alias("color_fidelity")).write.option("header", True).csv(path)
    return rd.read_grades_csv(t.spark, path).select("res", "ori", *[r6(c).alias(c) for c in ("overall", "sharpness", "color_fidelity")])


VEC = lambda i: r(f"embedding[{i}]::double")


@query("s5_embedding_reference", "emb_ref", f"select vec_id, len(embedding)::int as dims, {VEC(1)} as first, {VEC(64)} as last from emb_ref")
def s5(t):
    return t.emb_ref.select("vec_id", F.size("embedding").alias("dims"), r6(F.col("embedding")[0].cast("double")).alias("first"), r6(F.element_at("embedding", -1).cast("double")).alias("last"))


@query("s6_labelled_embeddings", "emb_eval", f"select vec_id, is_ood, category, {VEC(1)} as first from emb_eval")
def s6(t):
    return t.emb_eval.select("vec_id", "is_ood", "category", r6(F.col("embedding")[0].cast("double")).alias("first"))


@query("s7_ratings_by_file", "ratings", f"select replace(model_id, '_', '/') as model_id, ord, {r('score')} as score from ratings")
def s7(t):
    rows = rd.read_ratings_by_file(t.spark, rating_lines(t, by_file=True), RATING.replace("model_id string, ", ""))
    return rows.select("model_id", "ord", r6("score").alias("score"))


@query("s8_quarantine", "ratings", """select substr('{"ord":' || ord || ',"model_id"', 1, 12) as line, count(*) as n, true as numbered from ratings where score < 1.1 group by 1""")
def s8(t):
    """Bad lines of a log, all with their numbers in their file; scores below a limit are written as broken JSON."""
    path = fresh_path(t.spark, "broken")
    line = F.to_json(F.struct("ord", "model_id", "score"))
    broken = F.when(F.col("score") < 1.1, F.substring(line, 1, 12)).otherwise(line)
    t.ratings.repartitionByRange("ord").sortWithinPartitions("ord").select(broken.alias("value")).write.text(path)
    bad = rd.read_quarantined(t.spark, path, "ord bigint, model_id string, score double")[1]
    return bad.groupBy("line").agg(F.count_distinct("file", "line_number").alias("n"), (F.min("line_number") > 0).alias("numbered"))


@query("s9_jsonl_sink", "truth", f"select image_id, dimension, {r('gt')} as gt from truth")
def s9(t):
    """Written in two goes, the second appended, and read back."""
    path = fresh_path(t.spark, "sink")
    rows = t.truth.select(*KEYS, "gt")
    wr.write_jsonl(rows.where(F.col("dimension") == "overall"), path)
    wr.write_jsonl(rows.where(F.col("dimension") != "overall"), path, "append")
    return rd.read_jsonl(t.spark, path, "image_id bigint, dimension string, gt double").select(*KEYS, r6("gt").alias("gt"))


@query("s10_per_dimension_sink", "truth", f"select dimension, count(*) as n, {r('avg(gt)')} as mean_gt from truth group by 1")
def s10(t):
    path = fresh_path(t.spark, "dims")
    wr.write_per_dimension(t.truth.select(*KEYS, "gt"), path)
    rows = rd.read_jsonl(t.spark, path, "image_id bigint, gt double, dimension string")
    return rows.groupBy("dimension").agg(F.count(F.lit(1)).alias("n"), r6(F.avg("gt")).alias("mean_gt"))


@query("s11_annotation_queue", "bald_rows", f"""select image_id, dimension, {r('bald')} as bald_score, {r('entropy')} as entropy, {r('mos', 4)} as predicted_mos from (
        select * from bald_rows where image_id not in (from done_ids) order by bald desc, image_id, dimension limit 500)""")
def s11(t):
    from .q_uncertainty import queue

    path = fresh_path(t.spark, "queue")
    wr.write_jsonl(queue(t, 500), path)
    rows = rd.read_jsonl(t.spark, path, "image_id bigint, dimension string, bald_score double, entropy double, predicted_mos double")
    return rows.select(*KEYS, *[(F.col(c) + dbl(0)).alias(c) for c in ("bald_score", "entropy", "predicted_mos")])


WIDE_METRICS = ("plcc", "srcc", "mae", "rmse")


@query("s12_wide_export", "single_dim", "select model, max(n) as num_samples, " + ", ".join(
    f"{r(f'max({m}) filter (dimension = {chr(39)}{d}{chr(39)})')} as {d}_{m}" for d in ("overall", "sharpness", "color") for m in WIDE_METRICS)
    + f", {r('sum((case dimension when $$overall$$ then 0.5e0 else 0.25e0 end) * srcc)')} as wsrcc from single_dim group by 1")
def s12(t):
    from ..operators import agreement as ag
    from .q_ensemble import BY, scored

    m = staged(ag.metrics(scored(t), "score", "gt", BY), "metrics")
    wide = m.groupBy("model").pivot("dimension", ["overall", "sharpness", "color"]).agg(*[F.first(c).alias(c) for c in WIDE_METRICS])
    total = m.groupBy("model").agg(F.max("n").alias("num_samples"))
    rows = total.join(wide, "model").join(ag.weighted_over_dimensions(m, ["model"], {"srcc": "wsrcc"}), "model")
    path = fresh_path(t.spark, "benchmark")
    rows.write.option("header", True).csv(path)
    back = t.spark.read.schema(rows.schema).option("header", True).csv(path)
    return back.select("model", "num_samples", *[r6(c).alias(c) for c in back.columns if c not in ("model", "num_samples")])


@query("s13_rescale_export", "preds", f"""select p.image_id, dimension, {r('((mu - 1) / 4) * 4 + 1')} as mu, {r('(sigma_sq / 16) * 16')} as sigma_sq, {r('coalesce(d.distance, 0e0)')} as distance
        from preds p left join (select distinct l_orderkey as image_id, 30e0 + 40e0 * 0.5e0 as distance from lineitem where l_linenumber = 1) d using (image_id)""")
def s13(t):
    """Predictions exported on [0, 1] back on the grade scale; images without an embedding get distance 0."""
    raw = t.preds.select(*KEYS, ((F.col("mu") - 1) / 4).alias("mu"), (F.col("sigma_sq") / 16).alias("sigma_sq"))
    known = t.raw("lineitem").where("l_linenumber = 1").select(F.col("l_orderkey").alias("image_id")).distinct().withColumn("distance", dbl(50))
    return raw.join(known, "image_id", "left").select(*KEYS, r6(F.col("mu") * 4 + 1).alias("mu"), r6(F.col("sigma_sq") * 16).alias("sigma_sq"),
                                                      r6(F.coalesce("distance", dbl(0))).alias("distance"))


CHECKED = dict(v="""select image_id, n_lines, q, d, t, [q, 1 - q, 0e0, 0e0, t / 20] as p from base""",
    c="""select image_id, case when image_id % 11 = 0 then 'no record' else concat_ws(', ', case when image_id % 7 = 0 then 'unknown fields: author, rater' end, case when abs(list_sum(p) - 1) > 0.01 then 'level_probs sum' end,
    case when q * 6 > 5 then 'gt_score range' end, case when d - 0.05 < 0 then 'std range' end, case when t * 1.2 > 1 then 'weight range' end, case when n_lines - 2 > 2 or n_lines - 2 < 0 then 'category range' end) end as problems, q * 6 as gt from v""")


def record_lines(t):
    """Records as JSON lines; every seventh has fields that the record doesn't know, every eleventh line is cut."""
    c = F.col
    known = [c("image_id"), F.array(c("q"), 1 - c("q"), dbl(0), dbl(0), c("t") / 20).alias("level_probs"), (c("q") * 6).alias("gt_score"), (c("d") - dbl(0.05)).alias("std"),
             (c("t") * dbl(1.2)).alias("confidence_weight"), (c("n_lines") - 2).cast("int").alias("ood_category")]
    plain, more = F.to_json(F.struct(*known)), F.to_json(F.struct(*known, F.lit("x").alias("rater"), F.lit("y").alias("author")))
    line = F.when(c("image_id") % 7 == 0, more).otherwise(plain)
    return t.base.select(F.when(c("image_id") % 11 == 0, F.substring(line, 1, 9)).otherwise(line).alias("line"))


@query("s14_schema_check", "base", "select problems, count(*) as n from c where problems <> '' group by 1", **CHECKED)
def s14(t):
    """What is set aside, by problems."""
    _, bad = wr.checked_records(record_lines(t))
    return bad.groupBy(F.array_join("problems", ", ").alias("problems")).agg(F.count(F.lit(1)).alias("n"))


@query("s14_valid_records", "base", f"select image_id, {r('gt')} as gt_score from c where problems = ''", **CHECKED)
def s14_valid(t):
    """Records that keep every rule."""
    good, _ = wr.checked_records(record_lines(t))
    return good.select("image_id", r6("gt_score").alias("gt_score"))


@query("s15_manifest", "truth panel", f"""select 'v1' as version, sum(n)::bigint as total, {r('sum(cost)')} as total_cost, string_agg(stream || '/' || source || ':' || n, ', ' order by stream, source) as sources,
        'v1 (tier1): ' || sum(n) || ' records from ' || count(*) || ' sources' as summary from m""",
       m="select 'base' as stream, source, count(*) as n, 0e0 as cost from truth group by 2 union all select 'panel', model, count(*), count(*) * 0.002e0 from panel group by 2")
def s15(t):
    a = t.truth.select(F.lit("base").alias("stream"), "source", dbl(1).alias("confidence_weight"), dbl(0).alias("cost"))
    b = t.panel.select(F.lit("panel").alias("stream"), F.col("model").alias("source"), dbl(0.5).alias("confidence_weight"), dbl(0.002).alias("cost"))
    m = wr.manifest(a.unionByName(b), "v1", "tier1")
    listed = F.array_join(F.transform("sources", lambda s: F.concat(s["stream"], F.lit("/"), s["source"], F.lit(":"), s["count"].cast("string"))), ", ")
    return m.select("version", "total", r6("total_cost").alias("total_cost"), listed.alias("sources"), "summary")


# ---- projections and parsing -----------------------------------------------------------------------------

PATH_SQL = "'Data/' || upper(split[1:1]) || split[2:] || case when source = 'P' then '/crop/' else '/res/' end || split || case when source = 'P' then '_crop_' else '_res_' end || lpad(image_id::varchar, 7, '0') || case when source = 'F' then 'x.jpg' else '.jpg' end"
VIEWS["paths"] = ("truth_wide", f"select image_id, split, {PATH_SQL} as path from truth_wide")


def paths(t):
    kind = lambda a, b: F.when(F.col("source") == "P", a).otherwise(b)
    end = F.when(F.col("source") == "F", "x.jpg").otherwise(".jpg")
    path = F.concat(F.lit("Data/"), F.initcap("split"), kind("/crop/", "/res/"), F.col("split"), kind("_crop_", "_res_"), F.lpad(F.col("image_id").cast("string"), 7, "0"), end)
    return t.truth_wide.select("image_id", "split", path.alias("path"))


@query("p1_canonical_id", "paths", "select image_id, lpad(image_id::varchar, 7, '0') as canonical_id from paths")
def p1(t):
    return paths(t).select("image_id", rc.canonical_id(F.col("path"), strict=True).alias("canonical_id"))


@query("p2_split_from_path", "paths", "select image_id, split from paths")
def p2(t):
    return paths(t).select("image_id", rc.split_from_path(F.col("path")).alias("split"))


@query("p3_sibling_path", "paths", "select image_id, nullif(replace(replace(path, '/res/', '/ori/'), '_res_', '_ori_'), path) as sibling from paths")
def p3(t):
    return paths(t).select("image_id", rc.sibling_path(F.col("path")).alias("sibling"))


@query("p4_basename", "paths", "select image_id, regexp_extract(path, '[^/]*$') as name from paths")
def p4(t):
    return paths(t).select("image_id", rc.basename(F.col("path")).alias("name"))


@query("p5_flat_or_nested", "panel", f"select image_id, model, {r('max(score) filter (dimension = $$overall$$)')} as overall, {r('max(score) filter (dimension = $$sharpness$$)')} as sharpness, {r('max(score) filter (dimension = $$color$$)')} as color_fidelity from panel group by 1, 2")
def p5(t):
    wide = t.panel_wide.withColumnRenamed("color", "color_fidelity")
    names = ("overall", "sharpness", "color_fidelity")
    flat, nested = F.to_json(F.struct(*names)), F.to_json(F.struct(*[F.struct(F.col(n).alias("score")).alias(n) for n in names]))
    text = wide.select("image_id", "model", F.when(F.col("model").endswith("f"), nested).otherwise(flat).alias("record"))
    return text.select("image_id", "model", *rc.flexible_scores(F.col("record"))).select("image_id", "model", *[r6(n).alias(n) for n in names])


def responses(t):
    """Rating answers as models write them: plain, fenced, doubled braces, a missing key, another scale, prose."""
    wide = t.panel_wide
    o, s, c = [F.round(F.col(x), 2).cast("string") for x in ("overall", "sharpness", "color")]
    body = lambda *kv: F.concat(F.lit("{"), F.concat_ws(", ", *[F.concat(F.lit(f'"{k}": '), v) for k, v in kv]), F.lit("}"))
    full = body(("overall", o), ("sharpness", s), ("color_fidelity", c))
    m = F.col("model")
    text = (F.when(m == "rater_af", full).when(m == "rater_ao", F.concat(F.lit("```json\n"), full, F.lit("\n```")))
            .when(m == "rater_nf", F.concat(F.lit("{"), full, F.lit("}"))).when(m == "rater_no", body(("overall", o), ("color_fidelity", c)))
            .when(m == "rater_rf", body(("overall", o), ("sharpness", F.round(F.col("sharpness") * 2, 2).cast("string")), ("color_fidelity", c))).otherwise(F.concat(F.lit("I would say "), o)))
    return wide.select("image_id", "model", text.alias("response"))


VIEWS["rated"] = ("panel", """select image_id, model, round(max(score) filter (dimension = 'overall'), 2) as o, round(max(score) filter (dimension = 'sharpness'), 2) as s,
    round(max(score) filter (dimension = 'sharpness') * 2, 2) as s2, round(max(score) filter (dimension = 'color'), 2) as c from panel group by 1, 2""")
P6_ERR = """case model when 'rater_no' then 'missing key sharpness' when 'rater_ro' then 'no JSON object in response'
    when 'rater_rf' then case when s2 > 5 then 'sharpness score ' || s2::varchar || ' outside [1.0, 5.0]' else '' end else '' end"""


@query("p6_rating_response", "rated", "select image_id, model, case when e = '' then o end as overall, case when e = '' then case when model = 'rater_rf' then s2 else s end end as sharpness, case when e = '' then c end as color_fidelity, e as error from v",
       v=f"select *, {P6_ERR} as e from rated")
def p6(t):
    return rc.parse_rating(responses(t), "response").drop("response")


WORDS = "[['excellent', ' Excellent.', 'good', 'GOOD quality', 'fair...', 'Fairly', 'poor.', 'badly', 'bad', 'n/a']]"
ANSWERS = ("excellent", " Excellent.", "good", "GOOD quality", "fair...", "Fairly", "poor.", "badly", "bad", "n/a")
LABELS = ("excellent", "excellent", "good", "good", "fair", None, "poor", None, "bad", None)


@query("p7_level_word", "", "select event_id, ([" + ", ".join("null" if x is None else f"'{x}'" for x in LABELS) + "])[(cast(json_extract_string(props, '$.k') as int) % 10) + 1] as level from events")
def p7(t):
    k = (F.get_json_object("props", "$.k").cast("int") % 10) + 1
    answer = F.element_at(F.array(*[F.lit(a) for a in ANSWERS]), k)
    return t.raw("events").select("event_id", rc.level_word(answer).alias("level"))


@query("p8_single_score", "", """select event_id, case when value <= 5 and value >= 1 then value end as score,
        case when value between 1 and 5 then '' else 'score score ' || value::varchar || ' outside [1.0, 5.0]' end as error from events""")
def p8(t):
    text = F.concat(F.lit('```\n{"score": '), F.col("value").cast("string"), F.lit("}\n```"))
    return rc.parse_rating(t.raw("events").select("event_id", text.alias("response")), "response", keys=("score",)).drop("response")


@query("p9_ten_to_five", "base", f"select image_id, {r('(1 + 9 * q - 1) / 9 * 4 + 1')} as score from base")
def p9(t):
    return t.base.select("image_id", r6(rc.ten_to_five(1 + F.col("q") * 9)).alias("score"))


@query("p10_quality_to_mos", "base", f"select image_id, {r('1 + 4 * greatest(0e0, least(1e0, q * 1.4e0 - 0.2e0))')} as mos from base")
def p10(t):
    return t.base.select("image_id", r6(rc.quality_to_mos(F.col("q") * dbl(1.4) - dbl(0.2))).alias("mos"))


@query("p11_quality_bucket", "base", f"select image_id, {BUCKET('(6 * q)')} as bucket from base")
def p11(t):
    return t.base.select("image_id", rc.quality_bucket(F.col("q") * 6).alias("bucket"))


@query("p12_equal_width_level", "truth_wide", """select image_id, (case when overall <= lo + 0.2e0 * (hi - lo) + 1e-8 then 1 when overall <= lo + 0.4e0 * (hi - lo) + 1e-8 then 2
        when overall <= lo + 0.6e0 * (hi - lo) + 1e-8 then 3 when overall <= lo + 0.8e0 * (hi - lo) + 1e-8 then 4 else 5 end)::int as level
        from truth_wide, (select min(overall) as lo, max(overall) as hi from truth_wide)""")
def p12(t):
    rows = attach_one(t.truth_wide, t.truth_wide.agg(F.min("overall").alias("lo"), F.max("overall").alias("hi")))
    return rows.select("image_id", rc.equal_width_level(F.col("overall"), F.col("lo"), F.col("hi")).alias("level"))


@query("p13_dimension_alias", "panel", "select image_id, model, dimension from panel")
def p13(t):
    alias = F.when(F.col("dimension") != "color", F.col("dimension")).when(F.col("model").endswith("f"), "color_fidelity").when(F.col("model") == "rater_ao", "colour").otherwise("colour_fidelity")
    return t.panel.select("image_id", "model", rc.canonical_dimension(alias).alias("dimension"))


@query("p16_context", "", """select page_id, 'UNK' as domain, coalesce(nullif(regexp_extract(html, '<html lang="([a-z]+)"', 1), ''), 'und') as language, 'Zyyy' as script,
        case when contains(html, '<script') then 'web' else 'unknown' end as capture, contains(html, '<table') as has_table from pages""")
def p16(t):
    """Context of a page from the newest entry of its enrichment history."""
    lang = F.nullif(F.regexp_extract("html", '<html lang="([a-z]+)"', 1), F.lit(""))
    old = F.struct(F.lit("old").alias("domain_level1"), *[F.lit(None).cast(k).alias(n) for n, k in (("iso639_language", "string"), ("capture_method", "string"), ("has_table", "boolean"))])
    newest = F.struct(F.lit(None).cast("string").alias("domain_level1"), lang.alias("iso639_language"), F.when(F.col("html").contains("<script"), "web").alias("capture_method"), F.when(F.col("html").contains("<table"), True).alias("has_table"))
    text = F.to_json(F.struct(F.struct(F.array(F.struct(old.alias("data")), F.struct(newest.alias("data"))).alias("versions")).alias("enrichments")))
    return t.raw("pages").select("page_id", latest_context(text).alias("c")).select("page_id", "c.*")


def latest_context(text):
    """Snapshot of the newest enrichment version with defaults for what it lacks; NULL without versions."""
    entry = "struct<domain_level1:string,iso639_language:string,iso15924_script:string,capture_method:string,has_table:boolean>"
    parsed = F.from_json(text, f"enrichments struct<versions:array<struct<data:{entry}>>>")
    data = F.try_element_at(parsed["enrichments"]["versions"], F.lit(-1))["data"]
    default = lambda n, v: F.coalesce(data[n], F.lit(v))
    return F.when(data.isNotNull(), F.struct(
        default("domain_level1", "UNK").alias("domain"), default("iso639_language", "und").alias("language"), default("iso15924_script", "Zyyy").alias("script"),
        default("capture_method", "unknown").alias("capture"), default("has_table", False).alias("has_table")))


# Quality range per tier.
TIER_RANGES = (("ORIGINAL", 0.95, 1.0), ("PRISTINE", 0.95, 1.0), ("HIGH", 0.70, 0.95), ("MEDIUM", 0.40, 0.80), ("LOW", 0.10, 0.60), ("DEGRADED", 0.00, 0.50))


@query("p19_tier_ranges", "base", "select image_id, tier from base, r where q >= lo and q <= hi",
       r=" union all ".join(f"select '{n}' as tier, {lo}::double as lo, {hi}::double as hi" for n, lo, hi in TIER_RANGES))
def p19(t):
    hits = F.array_compact(F.array(*[F.when(F.col("q").between(lo, hi), F.lit(n)) for n, lo, hi in TIER_RANGES]))
    return t.base.select("image_id", F.explode(hits).alias("tier"))


# ---- joins of records ------------------------------------------------------------------------------------

@query("j4_aligned_embeddings", "emb", f"select vec_id, is_ood, {r('embedding[1]::double')} as first from emb")
def j4(t):
    e = t.embeddings
    return jn.with_matching_keys(e.select("vec_id", "is_ood"), e.select("vec_id", "embedding"), "vec_id").select(
        "vec_id", "is_ood", r6(F.col("embedding")[0].cast("double")).alias("first"))


@query("j7_resume", "ratings", """select distinct image_id, m.model_id from ratings r, (select distinct model_id from ratings) m
        where not exists (select 1 from ratings x where x.image_id = r.image_id and x.model_id = m.model_id and x.error = '' and x.arm = 'purchase')""")
def j7(t):
    models = t.ratings.agg(F.collect_set("model_id").alias("ms"))
    wanted = attach_one(t.ratings.select("image_id").distinct(), models).select("image_id", F.explode("ms").alias("model_id"))
    log = t.ratings.where(F.col("arm").isin("purchase", "error"))
    return jn.still_to_do(wanted, log, ["image_id", "model_id"])


@query("j8_precedence", "cross_scores preds", f"""select image_id, dimension, {r('coalesce(c.score, e.mu)')} as score, case when c.score is not null then 'specialist' else 'ensemble' end as origin
        from cross_scores c full outer join (select * from preds where dimension = 'overall') e using (image_id, dimension)""")
def j8(t):
    rows = jn.by_precedence(t.cross_scores, t.preds.withColumnRenamed("mu", "score"), "score")
    return rows.select(*KEYS, r6("score").alias("score"), "origin")


@query("j9_wide_inner", "cross_scores preds_wide truth_wide", f"select image_id, {r('p.overall_mu')} as overall, {r('x.score')} as sharpness, {r('w.color')} as color from preds_wide p join (select * from cross_scores where dimension = 'sharpness') x using (image_id) join truth_wide w using (image_id)")
def j9(t):
    wide = jn.wide_inner({"overall": t.preds_wide.select("image_id", F.col("overall_mu").alias("v")), "sharpness": t.cross_scores.where("dimension = 'sharpness'").select("image_id", F.col("score").alias("v")),
                          "color": t.truth_wide.select("image_id", F.col("color").alias("v"))}, "v")
    return wide.select("image_id", *[r6(c).alias(c) for c in ("overall", "sharpness", "color")])


LINES = "select l_orderkey as image_id, case l_returnflag when 'A' then 'overall' when 'N' then 'sharpness' else 'color' end as dimension, l_quantity as score, (l_linenumber::bigint * 1000000000 + l_partkey * 10000 + l_suppkey) * 100 + l_quantity::bigint as ord from lineitem"


@query("j10_wide_outer", "", "select image_id, arg_max(score, ord) filter (dimension = 'overall') as overall, arg_max(score, ord) filter (dimension = 'sharpness') as sharpness, arg_max(score, ord) filter (dimension = 'color') as color from l group by 1", l=LINES)
def j10(t):
    c = F.col
    dim = F.when(c("l_returnflag") == "A", "overall").when(c("l_returnflag") == "N", "sharpness").otherwise("color")
    order = (c("l_linenumber").cast("long") * 1000000000 + c("l_partkey") * 10000 + c("l_suppkey")) * 100 + c("l_quantity").cast("long")
    long = t.raw("lineitem").select(c("l_orderkey").alias("image_id"), dim.alias("dimension"), c("l_quantity").alias("score"), order.alias("ord"))
    return jn.wide_outer(long, "score", "ord", ("overall", "sharpness", "color"))


def _none(kind):
    return F.lit(None).cast(kind)


def _dimension(source, mos, human=None, weight=None):
    return F.struct(F.lit(source).alias("label_source"), mos.alias("mos"), (human if human is not None else _none("double")).alias("human"),
                    (weight if weight is not None else _none("double")).alias("acceptance"))


def human_records(t):
    w = t.truth_wide
    dims = F.map_from_arrays(F.array(F.lit("overall"), F.lit("color")), F.array(_dimension("human", F.col("overall"), F.col("overall")), _dimension("human", F.col("color"), F.col("color"))))
    return w.select(F.col("image_id").alias("canonical_id"), "split", _none("double").alias("ood"), F.array(F.struct(F.lit("judge_a").alias("model_id"), F.col("sharpness").alias("score"))).alias("vlm_evals"),
                    dims.alias("dimensions"), F.create_map(F.lit("source"), F.col("source"), F.lit("stage"), F.lit("human")).alias("tags"), F.lit(False).alias("is_pseudo_labeled"))


def machine_records(t):
    x = t.cross_scores.groupBy("image_id").agg(*[F.max(F.when(F.col("dimension") == d, F.col("score"))).alias(d) for d in ("overall", "sharpness")]).join(t.distances, "image_id")
    dims = F.map_from_arrays(F.array(F.lit("overall"), F.lit("sharpness")), F.array(_dimension("pseudo_label", F.col("overall"), None, dbl(0.5)), _dimension("pseudo_label", F.col("sharpness"), None, dbl(0.5))))
    return x.select(F.col("image_id").alias("canonical_id"), _none("string").alias("split"), F.col("distance").alias("ood"), F.array(*[F.struct(F.lit(m).alias("model_id"), F.col("overall").alias("score")) for m in ("judge_a", "judge_b")]).alias("vlm_evals"),
                    dims.alias("dimensions"), F.create_map(F.lit("stage"), F.lit("machine")).alias("tags"), F.lit(True).alias("is_pseudo_labeled"))


VIEWS["merged"] = ("truth_wide cross_scores distances", """select coalesce(w.image_id, x.image_id) as image_id, w.split, x.distance as ood, coalesce(x.o, w.overall) as overall_mos, w.overall as overall_human,
    case when x.image_id is not null then 'pseudo_label' else 'human' end as overall_source, x.s as sharpness_mos, w.color as color_mos, coalesce(x.o, w.sharpness) as judge_a, x.o as judge_b,
    w.source as tag_source, case when x.image_id is not null then 'machine' else 'human' end as tag_stage, x.image_id is not null as is_pseudo_labeled
    from truth_wide w full outer join (select c.image_id, max(score) filter (dimension = 'overall') as o, max(score) filter (dimension = 'sharpness') as s, max(distance) as distance
    from cross_scores c join distances using (image_id) group by 1) x on w.image_id = x.image_id""")
MERGED_NUM = ("ood", "overall_mos", "overall_human", "sharpness_mos", "color_mos", "judge_a", "judge_b")


@query("j13_merge_records", "merged", "select image_id, split, overall_source, tag_source, tag_stage, is_pseudo_labeled, " + ", ".join(f"{r(c)} as {c}" for c in MERGED_NUM) + " from merged")
def j13(t):
    m = jn.merge_records(human_records(t), machine_records(t))
    at = lambda c, k: F.try_element_at(c, F.lit(k))
    judge = lambda k: F.element_at(F.filter("vlm_evals", lambda e: e["model_id"] == k), 1)["score"] if k == "judge_a" else F.try_element_at(F.filter("vlm_evals", lambda e: e["model_id"] == k), F.lit(1))["score"]
    d = lambda k, f: at("dimensions", k)[f]
    num = {"ood": F.col("ood"), "overall_mos": d("overall", "mos"), "overall_human": d("overall", "human"), "sharpness_mos": d("sharpness", "mos"), "color_mos": d("color", "mos"), "judge_a": judge("judge_a"), "judge_b": judge("judge_b")}
    return m.select(F.col("canonical_id").alias("image_id"), "split", d("overall", "label_source").alias("overall_source"), at("tags", "source").alias("tag_source"), at("tags", "stage").alias("tag_stage"),
                    "is_pseudo_labeled", *[r6(v).alias(k) for k, v in num.items()])


J14 = dict(trained="select image_id, dimension, split from truth where split <> 'test' and (dimension <> 'color' or image_id % 3 > 0)", tested="select distinct image_id from truth where split = 'test' or image_id % 5 = 0",
           ids="select image_id from trained union select image_id from tested", contexts="select page_id as image_id from pages", evals="select image_id, model_id, max(ord) as ord from ratings where error = '' group by 1, 2",
           rec="""select i.image_id, case when image_id in (from (select image_id from tested)) then 'test' else (select any_value(split) from trained t where t.image_id = i.image_id) end as split from ids i""",
           facts="""select 'records' as what, 'all' as name from ids union all select 'split', split from rec union all select 'dimension', dimension from trained
               union all select 'layer', 'training' from (select distinct image_id from trained) union all select 'layer', 'test' from tested
               union all select 'layer', 'context' from contexts join ids using (image_id) union all select 'layer', 'ratings' from (select distinct image_id from evals) join ids using (image_id)
               union all select 'document', 'any' from contexts join ids using (image_id) union all select 'ratings', 'any' from (select distinct image_id from evals) join ids using (image_id)""")


def master_layers(t):
    """Training files per dimension, test manifest, page contexts, rating logs; the last two bring no new ids."""
    c = F.col
    train = t.truth.where((c("split") != "test") & ((c("dimension") != "color") | (c("image_id") % 3 > 0)))
    train = train.select(c("image_id").alias("canonical_id"), "split", F.create_map("dimension", _dimension("human", c("gt"), c("gt"))).alias("dimensions"), F.create_map(F.lit("source"), "source").alias("tags"), "dimension")
    test = t.truth_wide.where((c("split") == "test") | (c("image_id") % 5 == 0)).select(c("image_id").alias("canonical_id"), F.lit("test").alias("split"), F.concat(F.lit("ori/"), c("image_id").cast("string")).alias("image_path_ori"))
    lang = F.nullif(F.regexp_extract("html", '<html lang="([a-z]+)"', 1), F.lit(""))
    context = t.raw("pages").select(c("page_id").alias("canonical_id"), F.struct(F.coalesce(lang, F.lit("und")).alias("language"), F.length("html").alias("size")).alias("document"), F.lit("page").alias("image_detection_id"))
    log = t.ratings.where(c("error") == "").groupBy("image_id", "model_id").agg(F.max_by("score", "ord").alias("score"))
    evals = log.groupBy(c("image_id").alias("canonical_id")).agg(F.array_sort(F.collect_list(F.struct("model_id", "score"))).alias("vlm_evals"))  # an entry per rater
    return [("training", train, True), ("test", test, True), ("context", context, False), ("ratings", evals, False)]


@query("j14_master_build", "truth ratings", "select what, name, count(*) as n from facts group by 1, 2", **J14)
def j14(t):
    """Four layers merged into one record per image, and what they cover."""
    return jn.coverage(jn.build_master(master_layers(t), "dimension")).select("what", "name", "n")


@query("j14_master_records", "truth ratings truth_wide", f"""select i.image_id, split, {r("max(gt) filter (dimension = 'overall')")} as overall, {r("max(gt) filter (dimension = 'color')")} as color, max(case when image_id in (from (select image_id from tested)) then 'test' else 'training' end) as split_from,
        max((image_id in (select image_id from contexts))::int) as has_document, coalesce(max(k), 0)::bigint as n_raters, {r("max(best)")} as best_rating
        from rec i left join (select image_id, dimension, gt from trained join truth using (image_id, dimension)) using (image_id) left join (select image_id, count(*) as k, max(score) as best from evals join ratings using (image_id, model_id, ord) group by 1) using (image_id) group by 1, 2""", **J14)
def j14_records(t):
    """The merged records themselves with where their fields come from."""
    m = jn.build_master(master_layers(t), "dimension")
    of = lambda d: F.try_element_at("dimensions", F.lit(d))["mos"]
    evals = F.coalesce("vlm_evals", F.array().cast(m.schema["vlm_evals"].dataType))
    return m.select(F.col("canonical_id").alias("image_id"), "split", r6(of("overall")).alias("overall"), r6(of("color")).alias("color"), F.try_element_at("provenance", F.lit("split")).alias("split_from"),
                    F.col("document").isNotNull().cast("int").alias("has_document"), F.size(evals).cast("long").alias("n_raters"), r6(F.array_max(F.transform(evals, lambda e: e["score"]))).alias("best_rating"))


@query("j15_ratings_map", "scored", f"select image_id, count(*) as n_ratings, {r('max(score) filter (model = $$rater_af$$)')} as rater_af, {r('max(gt)')} as gt from scored where dimension = 'overall' group by 1")
def j15(t):
    """All ratings of one image in a map keyed model__strategy, its grade attached."""
    rows = t.panel_overall.join(t.truth_wide.select("image_id", F.col("overall").alias("gt")), "image_id")
    key = F.concat_ws("__", "model", F.lit("direct"))
    maps = rows.groupBy("image_id").agg(F.map_from_entries(F.collect_list(F.struct(key, "score"))).alias("ratings"), F.max("gt").alias("gt"))
    return maps.select("image_id", F.size("ratings").cast("long").alias("n_ratings"), r6(F.try_element_at("ratings", F.lit("rater_af__direct"))).alias("rater_af"), r6("gt").alias("gt"))
