import random
import zlib

import duckdb
import pytest

from scoreloom.llm import catalogue, personal, quality, stages, topk

from . import plain

SF = "/root/testdata/sf0.01"


def test_base_spans_equal_the_patterns():
    rng = random.Random(2)
    parts = ["1", "25", "0", "4", "9.", ".", " ", "-", "+", "(", ")", "a", "@", "é", "_", "%", "@b.c", "+1 23"]
    for _ in range(20000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 40)))
        assert personal.base_spans(text) == plain.personal(text)


def test_long_runs_take_linear_time():
    for text in ("1" * 300_000, "a" * 300_000, "a" * 300_000 + "@", "1." * 150_000, "+1" + " " * 300_000, "@" * 300_000):
        personal.base_spans(text)


def test_repeats_take_the_label_of_base_spans(spark, table):
    rng = random.Random(1)
    phone = lambda: f"+1 ({rng.randint(200, 999)}) 555-{rng.randint(1000, 9999)}"
    docs = [(i, f"call {phone()} now\nor order {rng.randint(10, 99)} item") for i in range(60)] + [(100, None), (101, "")]
    field = personal.fit(table(docs))
    text = "call +1 (234) 555-1234 now. later 555-1234 again"
    rows = {r.doc_id: r for r in personal.digests(personal.find(table([*docs, (200, text)]), field)).collect()}
    assert rows[100].spans == rows[101].spans == "" and rows[200].n_phone == 1 and rows[200].spans.startswith("phone:5:22")
    assert all(r.n_phone == 1 for i, r in rows.items() if i < 60)
    empty = personal.fit(table([]))
    assert personal.find(table([]), empty).count() == 0
    assert personal.digests(personal.find(table([(1, text)]), empty)).first().n_phone == 1


def test_messages_reach_repeats():
    tokens = personal.Tokens(["mail ab1@c.de then ab1@c.de"])
    assert tokens.skip[:, :2].tolist() == [[0, 1]] and tokens.labels.tolist() == [1, 1]


def test_top_k_equals_sql(spark, monkeypatch):
    for name, size in (("BLOCK", 16), ("GROUP", 4), ("SLICE", 3)):
        monkeypatch.setattr(topk, name, size)
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{SF}/embeddings.parquet'")
    got = sorted(map(tuple, catalogue.QUERIES["op9_topk"](spark, SF).collect()))
    assert got == sorted(con.execute(catalogue.ORACLES["op9_topk"]).fetchall())


def test_top_k_edges(spark):
    rows = [(0, None), (None, [1.0]), (50, [1.0, float("nan")]), (100, [1.0, None]), (150, [0.5, 0.25]), (150, [0.5, 0.25]), (7, [0.5]), (8, []), (9, [-1.0, 0.0]), (10, [0.5])]
    t = topk.whole_numbers(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
    asked = t.where("vec_id % 50 = 0")
    assert [tuple(r) for r in topk.search(asked, t, 5).orderBy("rank").collect()] == [(150, 1, 7, 16384), (150, 2, 10, 16384), (150, 3, 8, 0), (150, 4, 9, -32768)]
    assert topk.search(t.where("false"), t, 5).count() == 0 and topk.search(asked, t.where("false"), 5).count() == 0


def test_top_k_skips_blocks():
    import numpy as np

    rng = np.random.default_rng(3)
    blocks = [(np.arange(i * 50, i * 50 + 50), np.round(rng.normal(i * 100, 10, (50, 8)))) for i in range(12)]
    queries = np.abs(np.round(rng.normal(50, 10, (20, 8))))
    top, who, scored = topk.best(np.full(20, -1), queries, blocks, 5)
    every = queries @ np.concatenate([m for _, m in blocks]).T
    assert (top == -np.sort(-every, axis=1)[:, :5]).all() and scored <= 3 * 20


def test_quality_on_held_out_labels(spark):
    rows = catalogue.QUERIES["op10_quality"](spark, "/root/testdata/sf0.1")
    labels = {r.doc_id: r.quality for r in spark.read.parquet("/root/testdata/sf0.1/labels.parquet").collect()}
    got = [(r.predicted, labels[r.doc_id]) for r in rows.collect() if r.held_out and r.doc_id in labels and zlib.crc32(str(r.doc_id).encode()) % 3 == 1]
    bad = [p for p, y in got if y == 0]
    assert sum(p == y for p, y in got) >= 0.98 * len(got) and bad.count(0) >= 0.95 * len(bad)


def test_quality_edges(spark, table):
    docs = table([(1, None), (2, ""), (3, "plain words here"), (4, "LOUD!! LOUD!!"), (4, "LOUD!! LOUD!!")])
    labels = spark.createDataFrame([(3, 1), (4, 0), (4, 0), (9, 1), (1, None), (2, 7)], "doc_id long, quality int")
    model = quality.fit(docs, labels)
    assert model.converged
    scores = {r.doc_id: r.score for r in quality.score(docs, model).collect()}
    assert scores[3] > 0.5 > scores[4] and scores[1] == scores[2]
    assert quality.accepted(docs, model).columns == docs.columns
    assert quality.score(table([]), quality.fit(table([]), labels)).count() == 0


def test_shared_folder_is_demanded_of_a_cluster():
    class Conf:
        get = staticmethod(lambda key, default=None: default)

    class Session:
        conf = Conf

        class sparkContext:
            master, applicationId = "spark://somewhere", "x"
            getConf = staticmethod(lambda: Conf)

    with pytest.raises(ValueError):
        stages.shared_folder(Session)
