"""Builds of a version: gate, publication, refusal, repeated builds."""

import pytest

from scoreloom.operators import versions as ver
from scoreloom.operators.staging import fresh_path
from scoreloom.streaming import jobs

KIND = "image_id long, mos double, level_probs array<double>, source string, stream string, label_method string, weight double, cost double"


def rows(spark, n, source, probs, stream="s", cost=0.5):
    return spark.createDataFrame([(i, 1.0 + i % 5, probs, source, stream, "m", 0.7, cost) for i in range(n)], KIND)


def test_gate_publication_and_manifest(spark):
    root = fresh_path(spark, "versions")
    base = rows(spark, 20, "human", [0.2] * 5, "base", 0.0)
    lopsided = [rows(spark, 200, "x", [1.0, 0.0, 0.0, 0.0, 0.0])]
    with pytest.raises(ver.GateFailed) as failed:
        ver.build_version(root, "v1", base, lopsided, level_mass_min=0.05)
    assert failed.value.report["level_gate_passed"] is False
    assert ver.read_manifest(spark, root, "v1") is None
    with pytest.raises(FileNotFoundError):
        ver.read_version(spark, root, "v1")
    streams = [rows(spark, 50, "a", [0.2] * 5), rows(spark, 5, "b", [0.2] * 5)]
    with pytest.raises(ver.GateFailed):
        ver.build_version(root, "v1", base, streams, gates={"id_delta_passed": False})
    ver.build_version(root, "v1", base, streams, parent="v0", gates={"id_delta_passed": True})
    m = ver.read_manifest(spark, root, "v1")
    assert (m["total_samples"], m["new_samples"], m["holdout_samples"], m["parent_version"]) == (69, 49, 6, "v0")
    assert {s["name"]: s["count"] for s in m["sources"]} == {"human": 20, "a": 45, "b": 4} and m["cost"] == pytest.approx(24.5)
    assert m["validation_gates"]["level_gate_passed"] and m["validation_gates"]["id_delta_passed"]
    assert sum(m["quality_distribution"][k] for k in ("excellent_pct", "good_pct", "fair_pct", "poor_pct", "bad_pct")) == pytest.approx(100)
    data = ver.read_version(spark, root, "v1")
    assert data.count() == 75 and data.where("part = 'holdout'").count() == 6
    with pytest.raises(FileExistsError):
        ver.build_version(root, "v1", base, streams)
    assert ver.read_manifest(spark, root, "v1") == m


UPDATE = "canonical_id string, at int, split string, ood double, vlm_evals array<struct<model_id: string, score: double>>, dimensions map<string, struct<mos: double, human: double>>, tags map<string,string>, is_pseudo_labeled boolean"


def test_a_failed_batch_is_repeated_whole(spark, monkeypatch):
    root, folder = fresh_path(spark, "master"), fresh_path(spark, "updates")
    schema = spark.createDataFrame([], UPDATE).drop("at").schema
    master = jobs.Master(spark, root, schema, buckets=4)
    update = lambda i, at, split, **tags: (str(i), at, split, None, [("a", float(at))], {}, tags, False)
    stream = lambda: jobs.upsert_stream(spark.readStream.schema(UPDATE).parquet(folder), master, folder + "-checkpoint", "at")

    def add(rows):
        spark.createDataFrame(rows, UPDATE).coalesce(1).write.mode("append").parquet(folder)

    add([update(i, 1, "train", k="1") for i in range(20)])
    stream().awaitTermination()
    first, folders = master.version()
    assert master.read().count() == 20 and first == 0
    real, calls = jobs.put_once, []

    def broken(*args):
        calls.append(args)
        raise OSError("the driver is gone")

    add([update(3, 3, "test", k="3"), update(3, 2, "val", z="2"), update(99, 1, None)])
    monkeypatch.setattr(jobs, "put_once", broken)
    with pytest.raises(Exception):
        stream().awaitTermination()
    assert calls and master.version()[0] == 0 and master.read().count() == 20  # nothing of the batch is seen
    monkeypatch.setattr(jobs, "put_once", real)
    stream().awaitTermination()
    got = {r.canonical_id: r for r in master.read().collect()}
    assert len(got) == 21 and got["3"].split == "test" and got["3"].tags == {"k": "3", "z": "2"} and [tuple(e) for e in got["3"].vlm_evals] == [("a", 3.0)]
    number, now = master.version()
    assert number == 1 and sum(now[b] != folders.get(b) for b in now) <= 2  # other buckets stay where they were
    batch = spark.createDataFrame([update(3, 9, "late")], UPDATE)
    assert master.merge(batch, 1, "at") is False and master.read().where("split = 'late'").count() == 0


def test_records_are_split_in_two(spark):
    from scoreloom.sources import writers as wr

    lines = ['{"image_id": 1, "level_probs": [0.2, 0.2, 0.2, 0.2, 0.2], "gt_score": 3}', '{"image_id": 2, "level_probs": [1, 1, 0, 0, 0], "extra": 1, "also": 2}', '{"image_id": 3', "", None, "[1]",
             '{"image_id": 4, "level_probs": [1, 0, 0, 0], "std": -1}', '{"image_id": 5, "level_probs": [1, 0, 0, 0, 0], "confidence_weight": 1.5, "ood_category": 7}']
    good, bad = wr.checked_records(spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "nth int, line string"))
    assert [r.image_id for r in good.collect()] == [1]
    got = {r.nth: list(r.problems) for r in bad.collect()}
    assert got == {1: ["unknown fields: also, extra", "level_probs sum"], 2: ["no record"], 3: ["no record"], 4: ["no record"], 5: ["no record"], 6: ["level_probs length", "std range"], 7: ["weight range", "category range"]}
