"""Detector and neighbour queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.numerics import dbl, r6, safe_ratio
from ..operators import agreement as ag, vectors as vec
from ..operators.ranking import attach_one, quantiles
from ..operators.staging import staged
from .oracle_views import VIEWS, avg_rank, r
from .registry import query

VIEWS["dists"] = ("emb_ref emb_eval", """select e.vec_id, e.is_ood, e.category, r.vec_id as ref_id,
    sqrt(list_sum(list_transform(list_zip(e.embedding, r.embedding), lambda x: (x[1]::double - x[2]::double) * (x[1]::double - x[2]::double)))) as d,
    list_inner_product(e.embedding::double[], r.embedding::double[]) / (sqrt(list_inner_product(e.embedding::double[], e.embedding::double[])) * sqrt(list_inner_product(r.embedding::double[], r.embedding::double[]))) as c
    from emb_eval e, emb_ref r""")
VIEWS["near"] = ("dists", "select *, row_number() over (partition by vec_id order by d, ref_id) as rk from dists")
VIEWS["coords"] = ("emb_ref", "select i, avg(v) as mean, var_pop(v) as variance from (select unnest(embedding)::double as v, generate_subscripts(embedding, 1) as i from emb_ref) group by 1")
VIEWS["diag"] = ("coords emb_eval", """select vec_id, is_ood, category, sqrt(sum((v - mean) * (v - mean) / variance)) as distance from
    (select vec_id, is_ood, category, unnest(embedding)::double as v, generate_subscripts(embedding, 1) as i from emb_eval) join coords using (i) group by 1, 2, 3""")
VIEWS["diag_ref"] = ("coords emb_ref", """select vec_id, sqrt(sum((v - mean) * (v - mean) / variance)) as distance from
    (select vec_id, unnest(embedding)::double as v, generate_subscripts(embedding, 1) as i from emb_ref) join coords using (i) group by 1""")
KS = (1, 3, 5, 10, 20, 50, 100)
VIEWS["methods"] = ("near diag", """select 'knn10' as method, vec_id, is_ood, category, round(avg(d), 9) as score from near where rk <= 10 group by 2, 3, 4
    union all select 'cosine', vec_id, is_ood, category, round(1 - max(c), 9) from dists group by 2, 3, 4
    union all select 'energy', vec_id, is_ood, category, round(0e0 - ln(sum(exp(c))), 9) from dists group by 2, 3, 4
    union all select 'diagonal', vec_id, is_ood, category, round(distance, 9) from diag""")


def scores(t, k=100):
    return staged(vec.neighbour_scores(t.emb_eval, t.emb_ref, "vec_id", k=k), "neighbours")


@query("j19_nearest", "near", f"select vec_id, rk, ref_id, {r('d')} as distance from near where rk <= 10")
def j19(t):
    rows = vec.nearest(t.emb_eval, t.emb_ref, "vec_id", k=10)
    return rows.select("vec_id", F.posexplode("top").alias("i", "x")).select("vec_id", (F.col("i") + 1).cast("long").alias("rk"), F.col("x.id").alias("ref_id"), r6("x.d").alias("distance"))


@query("m11_knn_distance", "near", f"select vec_id, {r('avg(d)')} as score from near where rk <= 10 group by 1")
def m11(t):
    return vec.nearest(t.emb_eval, t.emb_ref, "vec_id", k=10).select("vec_id", r6(vec.knn_distance("top", 10)).alias("score"))


@query("m12_cosine", "dists", f"select vec_id, {r('1 - max(c)')} as score from dists group by 1")
def m12(t):
    return vec.nearest_cosine(t.emb_eval, t.emb_ref, "vec_id").select("vec_id", r6(dbl(1) - F.col("cos_max")).alias("score"))


@query("m13_energy", "dists", f"select vec_id, {r('0e0 - ln(sum(exp(c)))')} as score from dists group by 1")
def m13(t):
    return vec.neighbour_scores(t.emb_eval, t.emb_ref, "vec_id", k=1).select("vec_id", r6(-F.col("log_sum_exp")).alias("score"))


AUC = "(sum(rk) filter (is_ood = 1) - sum(is_ood) * (sum(is_ood) + 1) / 2e0) / nullif(sum(is_ood)::double * (count(*) - sum(is_ood)), 0)"


@query("m14_k_sweep", "near", f"select k, {r('auroc')} as auroc, k = (select arg_max(k, round(auroc, 9) - k * 1e-12) from a) as best from a",
       v="select k, vec_id, is_ood, round(avg(d), 9) as s from near, (select unnest([" + ", ".join(map(str, KS)) + "]) as k) where rk <= k group by 1, 2, 3",
       a=f"select k, {AUC} as auroc from (select *, {avg_rank('s', 'k')} as rk from v) group by 1")
def m14(t):
    pick = F.inline(F.array(*[F.struct(F.lit(k).alias("k"), F.round(vec.knn_distance("top", k), 9).alias("s")) for k in KS]))
    rows = staged(vec.nearest(t.emb_eval, t.emb_ref, "vec_id", k=max(KS)).select("vec_id", pick).join(t.emb_eval.select("vec_id", "is_ood"), "vec_id"), "sweep")
    auc = staged(ag.auroc(rows, "s", "is_ood", ["k"]), "auc")
    best = auc.agg(F.max_by("k", F.round("auroc", 9) - F.col("k") * 1e-12).alias("_b"))
    return attach_one(auc, best).select("k", r6("auroc").alias("auroc"), (F.col("k") == F.col("_b")).alias("best"))


@query("m10_diagonal_distance", "diag", f"select vec_id, {r('distance')} as distance from diag")
def m10(t):
    return vec.diagonal_distance(t.emb_eval, vec.moments(t.emb_ref, "embedding")).select("vec_id", r6("distance").alias("distance"))


@query("m10_mahalanobis")
def m10b(t):
    return vec.mahalanobis(t.emb_eval, vec.fit_detector(t.emb_ref)).select("vec_id", "is_ood", "category", "distance")


@query("m9_detector")
def m9(t):
    d = vec.fit_detector(t.emb_ref)
    rows = [(i, float(d.mean[i]), float(d.precision[i, i]), d.shrinkage) for i in range(len(d.mean))]
    return t.spark.createDataFrame(rows, "coordinate int, mean double, precision double, shrinkage double")


@query("m15_proxy_labels", "diag diag_ref", f"select vec_id, {r('distance')} as distance, (distance > p)::int as proxy from diag, (select quantile_cont(distance, 0.99) as p from diag_ref)")
def m15(t):
    params = vec.moments(t.emb_ref, "embedding")
    limit = quantiles(vec.diagonal_distance(t.emb_ref, params), "distance", {"p99": 0.99}).drop("size")
    rows = attach_one(vec.diagonal_distance(t.emb_eval, params), limit)
    return rows.select("vec_id", r6("distance").alias("distance"), (F.col("distance") > F.col("p99")).cast("int").alias("proxy"))


@query("m16_threshold_at_tpr", "diag", f"select {r('p')} as threshold, {r('avg((distance > p)::int) filter (is_ood = 1)')} as tpr, {r('avg((distance > p)::int) filter (is_ood = 0)')} as fpr from diag, (select quantile_cont(distance, 0.05) as p from diag where is_ood = 1) group by p")
def m16(t):
    rows = staged(vec.diagonal_distance(t.emb_eval, vec.moments(t.emb_ref, "embedding")).drop("embedding"), "diag")
    limit = quantiles(rows.where("is_ood = 1"), "distance", {"p": 1 - 0.95}).drop("size")
    flagged = attach_one(rows, limit).withColumn("hit", (F.col("distance") > F.col("p")).cast("int"))
    return flagged.agg(r6(F.max("p")).alias("threshold"), r6(F.avg(F.when(F.col("is_ood") == 1, F.col("hit")))).alias("tpr"), r6(F.avg(F.when(F.col("is_ood") == 0, F.col("hit")))).alias("fpr"))


def method_scores(t):
    near = scores(t, 10)
    diag = vec.diagonal_distance(t.emb_eval, vec.moments(t.emb_ref, "embedding"))
    parts = {"knn10": vec.knn_distance("top", 10), "cosine": dbl(1) - F.col("cos_max"), "energy": -F.col("log_sum_exp")}
    rows = near.select("vec_id", F.inline(F.array(*[F.struct(F.lit(n).alias("method"), s.alias("score")) for n, s in parts.items()])))
    rows = rows.unionByName(diag.select("vec_id", F.lit("diagonal").alias("method"), F.col("distance").alias("score")))
    return staged(rows.withColumn("score", F.round("score", 9)).join(t.emb_eval.select("vec_id", "is_ood", "category"), "vec_id"), "methods")


@query("r16_auroc_per_category", "methods", f"select method, category, {r(AUC)} as auroc, sum(is_ood)::bigint as n_ood from (select *, {avg_rank('score', 'method, category')} as rk from v) group by 1, 2 having sum(is_ood) >= 5",
       v="select method, category, score, 1 as is_ood from methods where is_ood = 1 union all select m.method, c.category, m.score, 0 from methods m, (select distinct category from methods where is_ood = 1) c where m.is_ood = 0")
def r16(t):
    rows = method_scores(t)
    cats = rows.where("is_ood = 1").agg(F.collect_set("category").alias("_cats"))  # one entry per category
    own = F.when(F.col("is_ood") == 1, F.array("category")).otherwise(F.col("_cats"))
    spread = staged(attach_one(rows, cats).select("method", "score", "is_ood", F.explode(own).alias("category")), "spread")
    out = ag.auroc(spread, "score", "is_ood", ["method", "category"]).where("n_pos >= 5")
    return out.select("method", "category", r6("auroc").alias("auroc"), F.col("n_pos").alias("n_ood"))


ROC = """select distinct method, score, sum(is_ood) over w as tp, count(*) over w as cum, sum(is_ood) over (partition by method) as pos, count(*) over (partition by method) as n from methods window w as (partition by method order by score desc)"""


@query("r17_method_table", "methods", f"select method, {r('auroc')} as auroc, {r('auprc')} as auprc, {r('fpr')} as fpr95 from a join p using (method) join f using (method)", roc=ROC,
       a=f"select method, {AUC} as auroc from (select *, {avg_rank('score', 'method')} as rk from methods) group by 1",
       p="""select method, sum((tp - tp0) / pos::double * (tp / cum::double + case when cum0 > 0 then tp0 / cum0::double else 1e0 end) / 2) as auprc from (select *, coalesce(lag(tp) over (partition by method order by score desc), 0) as tp0,
            coalesce(lag(cum) over (partition by method order by score desc), 0) as cum0 from roc) group by 1""",
       f="select method, arg_max((cum - tp) / (n - pos)::double, score) as fpr from roc where tp / pos::double >= 0.95 group by 1")
def r17(t):
    rows = method_scores(t)
    out = ag.auroc(rows, "score", "is_ood", ["method"]).join(ag.auprc(rows, "score", "is_ood", ["method"]), "method").join(ag.fpr_at_tpr(rows, "score", "is_ood", 0.95, ["method"]), "method")
    return out.select("method", r6("auroc").alias("auroc"), r6("auprc").alias("auprc"), r6("fpr").alias("fpr95"))


@query("m8_ridge_probe")
def m8(t):
    """Best penalty per target by rank correlation on held-out rows."""
    e = t.embeddings.withColumn("a", F.substring("category", 2, 2).cast("double"))
    e = e.withColumn("b", F.col("embedding")[0].cast("double") * F.col("a"))
    preds = staged(vec.ridge_probe(e.where("split <> 'test'"), e.where("split = 'test'"), "embedding", ("a", "b"), "vec_id"), "ridge")
    per = ag.metrics(preds, "prediction", "truth", ["target", "alpha"])
    return per.groupBy("target").agg(F.max_by(F.struct("alpha", "srcc", "plcc", "mae"), "srcc").alias("x")).select("target", "x.*")
