import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from scoreloom.functions import text as tx
from scoreloom.operators import assembly as asm, calibration as cal, chat, joins as jn, records as rc, vectors as vec
from scoreloom.operators.staging import fresh_path
from scoreloom.sources import readers as rd, writers as wr
from scoreloom.streaming import jobs


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        prev, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            prev, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, prev + (x != y))
    return row[-1]


def test_error_rates_against_brute_force(spark):
    rnd = random.Random(5)
    words = ["élan", "the", "a", "scan", "of", "paper", "übung", "x"]
    pairs = [("", ""), ("", "a"), ("a", ""), ("the cat sat", "the cat sit")] + [(" ".join(rnd.choices(words, k=rnd.randint(1, 30))), " ".join(rnd.choices(words, k=rnd.randint(1, 30)))) for _ in range(40)]
    df = spark.createDataFrame(pairs, "a string, b string").select("a", "b", tx.normalised(F.col("a")).alias("r"), tx.normalised(F.col("b")).alias("h"))
    for r in df.select("*", tx.cer(F.col("r"), F.col("h")).alias("c"), tx.wer(F.col("r"), F.col("h")).alias("w")).collect():
        if not r.a or not r.b:
            want = (0.0, 0.0) if r.a == r.b else (1.0, 1.0)
        else:
            want = (edits(r.a, r.b) / len(r.a), edits(r.a.split(), r.b.split()) / len(r.a.split()))
        assert (r.c, r.w) == pytest.approx(want)


def test_normalisation_composes_and_collapses(spark):
    r = spark.createDataFrame([("  École\n\tA  ",)], "t string").select(tx.normalised(F.col("t")).alias("n")).first()
    assert r.n == "école a"


def test_detector_against_numpy(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 6)) @ rng.normal(size=(6, 6))
    df = spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "id bigint, embedding array<double>").repartition(5)
    d = vec.fit_detector(df)
    c = x - x.mean(0)
    s = c.T @ c / len(x)
    p, n = 6, len(x)
    mu = np.trace(s) / p
    delta = ((s * s).sum() - p * mu**2) / p
    beta = min(((c**2).sum(1) ** 2).sum() / n - (s * s).sum(), delta * p * n) / (p * n)
    shrunk = (1 - beta / delta) * s + beta / delta * mu * np.eye(p)
    assert np.allclose(d.precision, np.linalg.inv(shrunk)) and 0 <= d.shrinkage <= 1
    got = {r.id: r.distance for r in vec.mahalanobis(df, d).collect()}
    assert got[7] == pytest.approx(np.sqrt(c[7] @ np.linalg.inv(shrunk) @ c[7]))


def test_neighbours_over_many_blocks(spark):
    rng = np.random.default_rng(2)
    ref, q = rng.normal(size=(130, 5)), rng.normal(size=(40, 5))
    table = lambda m: spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(m)], "id bigint, embedding array<double>")
    got = {r.id: r for r in vec.neighbour_scores(table(q), table(ref), "id", k=4, block=16).collect()}
    dist = np.linalg.norm(q[:, None] - ref, axis=2)
    cos = (q / np.linalg.norm(q, axis=1, keepdims=True)) @ (ref / np.linalg.norm(ref, axis=1, keepdims=True)).T
    for i in range(40):
        assert [x.id for x in got[i].top] == list(np.argsort(dist[i])[:4])
        assert got[i].cos_max == pytest.approx(cos[i].max()) and got[i].log_sum_exp == pytest.approx(np.log(np.exp(cos[i]).sum()))


def test_ridge_against_closed_form(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(80, 4))
    y = x @ [1.0, -2.0, 0.5, 0.0] + 3 + 0.1 * rng.normal(size=80)
    df = spark.createDataFrame([(i, [float(v) for v in r], float(t)) for i, (r, t) in enumerate(zip(x, y))], "id bigint, v array<double>, y double")
    got = {r.id: r.prediction for r in vec.ridge_probe(df, df, "v", ["y"], "id", alphas=(10.0,)).collect()}
    z = (x - x.mean(0)) / x.std(0)
    w = np.linalg.solve(z.T @ z + 10 * np.eye(4), z.T @ (y - y.mean()))
    assert got[3] == pytest.approx(z[3] @ w + y.mean())


def test_logistic_fits(spark):
    rng = np.random.default_rng(0)
    x = rng.uniform(0, 10, 400)
    y = (4.5 - 1.2) / (1 + np.exp(-(x - 5) / 0.9)) + 1.2
    df = spark.createDataFrame([("m", float(a), float(b)) for a, b in zip(x, y)], "model string, score double, gt double")
    fit = cal.logistic_fit(df, by=["model"]).first()
    assert fit.converged and fit.sse < 1e-6 and sorted(round(v, 2) for v in fit.p[:2]) == [1.2, 4.5]
    assert not cal.logistic_fit(df, by=["model"], steps=2).first().converged
    bent = 2.0 * (0.5 - 1 / (1 + np.exp(1.3 * (x - 4)))) + 0.3 * x + 1
    five = cal.logistic_fit(spark.createDataFrame([("m", float(a), float(b)) for a, b in zip(x, bent)], "model string, score double, gt double"), by=["model"], parameters=5)
    got = five.first()
    assert got.converged and np.allclose(got.p, [2.0, 1.3, 4, 0.3, 1], atol=1e-3)
    out = cal.apply_logistic(df, five, ["model"], parameters=5).select("score", "calibrated").first()
    assert out.calibrated == pytest.approx(2.0 * (0.5 - 1 / (1 + np.exp(1.3 * (out.score - 4)))) + 0.3 * out.score + 1, abs=1e-3)


def test_noisy_logistic_is_a_minimum(spark):
    """At the converged parameters no nearby parameters have a smaller error."""
    rng = np.random.default_rng(4)
    x = rng.uniform(0, 10, 300)
    y = 3 / (1 + np.exp(-(x - 4) / 1.1)) + 1 + rng.normal(0, 0.4, 300)
    fit = cal.logistic_fit(spark.createDataFrame([(float(a), float(b)) for a, b in zip(x, y)], "score double, gt double")).first()
    error = lambda p: ((y - ((p[0] - p[1]) / (1 + np.exp(-(x - p[2]) / p[3])) + p[1])) ** 2).sum()
    assert fit.converged and fit.sse == pytest.approx(error(fit.p), rel=1e-9)
    for i in range(4):
        for step in (1e-3, -1e-3):
            moved = list(fit.p)
            moved[i] += step
            assert error(moved) > fit.sse


def test_calibration_methods_compared(spark):
    rng = np.random.default_rng(7)
    rows = []
    for i in range(300):
        x = float(np.round(rng.uniform(1, 5), 1))
        rows += [("bent", i, x, float(4 / (1 + np.exp(-3 * (x - 3))) + 1), "train" if i < 200 else "test"), ("line", i, x, 0.5 * x + 2, "train" if i < 200 else "test")]
    df = spark.createDataFrame(rows, "model string, image_id long, score double, gt double, split string")
    done = cal.calibrated(df, F.col("split") == "train", ["model"])
    got = {(r.model, r.split, r.method): r for r in cal.compare(done, ["model", "split"]).collect()}
    assert {m for (g, s, m), r in got.items() if r.best and g == "line"} == {"linear"}
    assert got["bent", "test", "logistic"].mae < 1e-4 < got["bent", "test", "linear"].mae
    assert got["bent", "test", "isotonic"].srcc == pytest.approx(1) and got["line", "test", "linear"].reduction_pct == pytest.approx(100)
    assert all(r.n == (200 if s == "train" else 100) for (_, s, _), r in got.items())
    assert cal.compare(done, ["model", "split"], min_rows=150).where("split = 'test'").count() == 0


def test_rating_responses(spark):
    body = '{"overall": 3.5, "sharpness": 2, "color_fidelity": 4}'
    texts = [body, f"```json\n{body}\n```", "{" + body + "}", '{"overall": 3.5}', body.replace("3.5", "7"), "no idea"]
    rows = rc.parse_rating(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string"), "t").orderBy("i").collect()
    assert [r.error for r in rows] == ["", "", "", "missing key sharpness", "overall score 7.0 outside [1.0, 5.0]", "no JSON object in response"]
    assert rows[1].overall == 3.5 and rows[4].overall is None


def test_paths_and_words(spark):
    df = spark.createDataFrame([("D/test/res/test_res_00017.jpg",), ("x/img00042_v2.png",), ("n/a.png",)], "p string")
    rows = df.select(rc.canonical_id(F.col("p")).alias("i"), rc.split_from_path(F.col("p")).alias("s"), rc.sibling_path(F.col("p")).alias("o")).collect()
    assert [(r.i, r.s) for r in rows] == [("00017", "test"), ("00042", None), (None, None)] and rows[0].o.endswith("ori/test_ori_00017.jpg") and rows[1].o is None
    with pytest.raises(Exception):
        df.select(rc.canonical_id(F.col("p"), strict=True)).collect()
    words = spark.createDataFrame([("Bad.",), ("badly",), ("good quality",), ("",)], "t string").select(rc.level_word(F.col("t")).alias("w")).collect()
    assert [r.w for r in words] == ["bad", None, "good", None]


def test_last_line_wins_and_quarantine(spark):
    path = fresh_path(spark, "t")
    lines = ['{"image": "a", "v": 1}', "", '{"image": "b", "v": 2}', '{"image": "a", "v": 3}', "{broken"]
    spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1).write.text(path)
    good, bad = rd.read_quarantined(spark, path, "image string, v int")
    assert [(r.line_number, r.line) for r in bad.collect()] == [(5, "{broken")] and good.count() == 3
    last = {r.image: r.v for r in rd.read_last_per_key(spark, path, "image string, v int", ["image"]).collect() if r.image}
    assert last == {"a": 3, "b": 2}
    with pytest.raises(Exception):
        rd.read_strict(spark, path, "image string, v int").collect()


def test_merge_precedence(spark):
    kind = "canonical_id string, split string, image_path_res string, vlm_evals array<struct<model_id: string, score: double>>, dimensions map<string, struct<mos: double, human: double>>, tags map<string,string>, is_pseudo_labeled boolean"
    old = spark.createDataFrame([("1", "train", "p", [("a", 1.0)], {"overall": (3.0, 3.0)}, {"k": "old", "z": "1"}, False), ("2", None, "q", [], {}, {}, False)], kind)
    new = spark.createDataFrame([("1", None, "other", [("a", 2.0), ("b", 5.0)], {"overall": (4.0, None), "color": (2.0, None)}, {"k": "new"}, True)], kind)
    got = {r.canonical_id: r for r in jn.merge_records(old, new).collect()}
    r = got["1"]
    assert (r.split, r.image_path_res, r.is_pseudo_labeled) == ("train", "p", True) and r.tags == {"k": "new", "z": "1"}
    assert (r.dimensions["overall"].mos, r.dimensions["overall"].human, r.dimensions["color"].mos) == (4.0, 3.0, 2.0)
    assert {e.model_id: e.score for e in r.vlm_evals} == {"a": 2.0, "b": 5.0} and got["2"].image_path_res == "q"


UPDATE = "canonical_id string, at int, split string, ood double, vlm_evals array<struct<model_id: string, score: double>>, dimensions map<string, struct<mos: double, human: double>>, tags map<string,string>, is_pseudo_labeled boolean"


def test_updates_of_one_id_are_folded(spark):
    rows = [("1", 3, "test", None, [("a", 3.0)], {"color": (2.0, None)}, {"k": "3"}, False), ("1", 1, "train", 0.5, [("a", 1.0), ("a", 1.5), ("b", 5.0)], {"color": (1.0, 4.0)}, {"k": "1", "z": "1"}, True),
            ("1", 2, None, 0.7, None, None, None, None), ("2", 1, None, None, [], {}, {}, False)]
    got = {r.canonical_id: r for r in jn.fold_records(spark.createDataFrame(rows, UPDATE), "at").collect()}
    r = got["1"]
    assert len(got) == 2 and (r.split, r.ood, r.is_pseudo_labeled) == ("test", 0.7, True) and r.tags == {"k": "3", "z": "1"}
    assert (r.dimensions["color"].mos, r.dimensions["color"].human) == (2.0, 4.0) and {e.model_id: e.score for e in r.vlm_evals} == {"a": 3.0, "b": 5.0}


def test_streamed_upserts_with_repeated_ids(spark):
    folder, kept = fresh_path(spark, "updates"), {}
    names = ["canonical_id", "split", "ood", "vlm_evals", "dimensions", "tags", "is_pseudo_labeled"]

    def current(ids):
        return kept["now"].join(ids, "canonical_id", "left_semi") if "now" in kept else spark.createDataFrame([], UPDATE).drop("at")

    def store(df):
        path = fresh_path(spark, "master")
        df.select(*names).write.parquet(path)
        kept["now"] = spark.read.parquet(path)

    for step in (1, 2):
        rows = [("1", k, f"s{step}{k}", None, [("a", float(step * 10 + k))], {}, {}, False) for k in (2, 1)]
        spark.createDataFrame(rows, UPDATE).write.mode("append").parquet(folder)
        jobs.upsert_batches(spark.readStream.schema(UPDATE).parquet(folder), current, store, folder + "-checkpoint", "at").awaitTermination()
        r, = kept["now"].collect()
        assert r.split == f"s{step}2" and [tuple(e) for e in r.vlm_evals] == [("a", step * 10 + 2.0)]


def test_alignment_fails_on_missing_partner(spark):
    with pytest.raises(Exception):
        jn.with_matching_keys(spark.range(3), spark.range(4), "id").collect()
    with pytest.raises(ValueError):
        wr.require_known_fields(spark.range(1), ["other"])


def test_sampling_rules(spark):
    df = spark.range(1000).select(F.col("id").alias("k"), F.when(F.col("id") < 995, "big").otherwise("small").alias("source"), (F.col("id") % 40 / 10.0 + 1).alias("s"))
    counts = {(r.source, r.part): r["count"] for r in asm.holdout_split(df, "k").groupBy("source", "part").count().collect()}
    assert counts == {("big", "holdout"): 99, ("big", "train"): 896, ("small", "holdout"): 1, ("small", "train"): 4}
    sampled = asm.resample_exact(df, "k", F.lit(2500))
    assert sampled.count() == 2500 and sampled.select("k").distinct().count() == 1000
    assert asm.resample_exact(df, "k", F.lit(300)).select("k").distinct().count() == 300
    tiers = {r.tier: r["count"] for r in asm.plan_tiers(df, "k").groupBy("tier").count().collect()}
    assert tiers == {"pristine": 100, "light": 250, "moderate": 350, "heavy": 200, "historical": 100}
    assert asm.select_bases(df, "s", "k", 350, "stratified").select("k").distinct().count() == 350
    partners = asm.random_partner(df, "k", "source").collect()
    assert len(partners) == 1000 and all(r.k != r.partner for r in partners)


def test_packing_invariants(spark):
    df = spark.createDataFrame([(i, 1 + (i * 37) % 120) for i in range(300)], "id int, n int")
    rows = chat.pack(df, "id", "n", 100, buckets=4).toPandas()
    assert set(rows["id"]) == {i for i in range(300) if 1 + (i * 37) % 120 <= 100}
    assert rows.groupby(["bucket", "sequence"])["n"].sum().max() <= 100
    for _, part in rows.groupby("bucket"):  # first fit, largest first
        room, want = [], {}
        for i, n in part.sort_values(["n", "id"], ascending=[False, True])[["id", "n"]].itertuples(index=False):
            spot = next((s for s, left in enumerate(room) if left >= n), len(room))
            if spot == len(room):
                room.append(100)
            room[spot] -= n
            want[i] = spot
        assert dict(zip(part["id"], part["sequence"])) == want
    more = chat.pack(df.unionAll(df.selectExpr("id + 1000", "n")), "id", "n", 100, buckets=4).toPandas()
    assert more[more.id < 300].set_index("id")["bucket"].sort_index().equals(rows.set_index("id")["bucket"].sort_index())
    with pytest.raises(ValueError):
        chat.pack(df, "id", "n", 100, buckets=2, most=20)


def test_conversation_forms(spark):
    turns = [("a", [("system", "s"), ("user", "q"), ("assistant", "r")]), ("b", [("user", "q"), ("user", "q2")]), ("c", [("user", "q"), ("assistant", "r"), ("user", "x")])]
    df = spark.createDataFrame(turns, "id string, turns array<struct<role: string, value: string>>")
    got = {r.id: r for r in chat.conversations_to_chat(df).collect()}
    assert got["a"].system == "s" and not got["a"].broken and got["a"].responses[0].content == "r" and len(got["a"].messages) == 1
    assert got["b"].broken and got["c"].broken and got["b"].messages == []


def test_decisions_on_a_stream(spark):
    from scoreloom.streaming import jobs

    src, out, mark = (fresh_path(spark, n) for n in ("in", "out", "mark"))
    row = dict(image_id=1, dimension="overall", distance=70.0, jsd=0.0, sigma_sq=0.1, entropy=0.1)
    spark.createDataFrame([(json.dumps(row),)], "value string").write.text(src)
    stream = jobs.rating_stream(spark, src, "image_id bigint, dimension string, distance double, jsd double, sigma_sq double, entropy double")
    jobs.write_stream(jobs.decided_stream(stream), out, mark).awaitTermination(60)
    assert [r.tier for r in spark.read.parquet(out).collect()] == ["hard_reject"]


def test_master_layers_and_provenance(spark):
    kind = "canonical_id long, split string, dimensions map<string, struct<label_source: string, mos: double>>, dimension string"
    train = spark.createDataFrame([(1, "train", {"overall": ("human", 4.0)}, "overall"), (1, "val", {"color": ("human", 2.0)}, "color"), (2, "train", None, "overall")], kind)
    test = spark.createDataFrame([(2, "test", {"overall": (None, 3.5)}), (3, "test", None)], "canonical_id long, split string, dimensions map<string, struct<label_source: string, mos: double>>")
    context = spark.createDataFrame([(1, ("en",)), (9, ("de",))], "canonical_id long, document struct<language: string>")
    evals = spark.createDataFrame([(1, [("a", 1.0)]), (1, [("b", 2.0), ("a", 3.0)])], "canonical_id long, vlm_evals array<struct<model_id: string, score: double>>")
    master = jn.build_master([("train", train, True), ("test", test, True), ("context", context, False), ("ratings", evals.limit(1), False), ("more", spark.createDataFrame([(1, [("a", 3.0), ("b", 2.0)])], evals.schema), False)], "dimension")
    got = {r.canonical_id: r for r in master.collect()}
    assert set(got) == {1, 2, 3}  # 9 is known to no layer that brings ids
    assert set(got[1].dimensions) == {"overall", "color"} and got[1].split == "train"  # color comes before overall
    assert {e.model_id: e.score for e in got[1].vlm_evals} == {"a": 3.0, "b": 2.0}
    assert got[1].provenance == {"split": "train", "document": "context", "dimensions.overall": "train", "dimensions.color": "train"}
    assert got[2].split == "test" and got[2].provenance == {"split": "test", "dimensions.overall": "test"} and got[2].dimensions["overall"].mos == 3.5
    n = {(r["what"], r["name"]): r["n"] for r in jn.coverage(master).collect()}
    assert n["records", "all"] == 3 and n["split", "test"] == 2 and n["dimension", "overall"] == 2 and n["document", "any"] == 1 and n["layer", "train"] == 2
