"""Faults of round 3: keys of two types, a line of 0, a spread of just the limit."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from scoreloom.functions import levels as lv
from scoreloom.llm import topk
from scoreloom.operators import assembly as asm, slices, vectors as vec


@pytest.fixture
def many_tasks(spark):
    """Every key of a shuffle in a task of its own, as on a large table."""
    names = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": "13"}
    before = {n: spark.conf.get(n) for n in names}
    for n, v in names.items():
        spark.conf.set(n, v)
    yield spark
    for n, v in before.items():
        spark.conf.set(n, v)


def vectors(spark, n, first=0):
    x = np.random.default_rng(n).integers(-200, 200, (n, 5))
    return x, spark.createDataFrame([(first + i, [int(v) for v in row]) for i, row in enumerate(x)], "vec_id long, cells array<long>")


def test_top_k_meets_every_group(many_tasks, monkeypatch):
    for name, size in (("BLOCK", 8), ("GROUP", 2), ("SLICE", 3)):
        monkeypatch.setattr(topk, name, size)
    x, table = vectors(many_tasks, 90)
    got = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in topk.search(table.where("vec_id % 10 = 0"), table, 5).collect()}
    want = {}
    for q in range(0, 90, 10):
        best = sorted((-int(x[q] @ x[i]), i) for i in range(90) if i != q)[:5]
        want |= {(q, n + 1): (i, -s) for n, (s, i) in enumerate(best)}
    assert got == want


def test_nearest_meets_every_cell(many_tasks, monkeypatch):
    monkeypatch.setattr(vec, "PER_CELL", 10)
    x, table = vectors(many_tasks, 80)
    table = table.select("vec_id", F.transform("cells", lambda v: v.cast("double")).alias("embedding"))
    got = {r.vec_id: [n["id"] for n in r.top] for r in vec.nearest(table, table, "vec_id", k=4).collect()}
    assert got == {q: [i for _, i in sorted((int(((x[q] - x[i]) ** 2).sum()), i) for i in range(80))[:4]] for q in range(80)}


def test_linear_fix_over_a_line_of_zero(spark):
    rows = [([0.0, 0.0, 0.5, 1e-9, 0.0], 2.4), ([0.0, 0.0, 0.5, 1.0000004e-9, 0.0], 2.4), ([0.1, 0.2, 0.4, 0.2, 0.1], 3.0)]
    got = [r.x for r in spark.createDataFrame(rows, "p array<double>, s double").select(lv.linear_fix(F.col("p"), F.col("s")).alias("x")).collect()]
    assert all(abs(x.alpha) > 1e6 for x in got[:2]) and got[2].alpha == 0 and got[2].beta == pytest.approx(0.2)


def test_a_spread_of_just_the_limit_is_not_above(spark):
    rows = [(i, "color", rater, score) for i in range(40) for rater, score in (("a", 2.9 + i / 10), ("b", 3.9 + i / 10), ("c", 4.9 + i / 10))]
    rows += [(99, "color", "a", 1.0), (99, "color", "b", 3.0)]
    ratings = spark.createDataFrame(rows, "image_id long, dimension string, rater string, score double").repartition(7)
    anchors = spark.createDataFrame([(99, "color", 2.0)], "image_id long, dimension string, known_mos double")
    high = {r.image_id for r in asm.process_raters(ratings, anchors).where("high_variance").collect()}
    assert high == {99}


def test_a_slice_stays_small_on_a_large_table(spark):
    """What a Python worker holds doesn't grow with the table."""
    for rows in (3_000_000, 30_000_000, 180_000_000):
        assert rows / slices.slices_for(spark.range(1), rows) <= 250_000


@pytest.mark.parametrize("name", ["j16_rater_pairs", "m5_cross_validated_linear"])
def test_every_row_is_returned(spark, name):
    import duckdb

    import __spark_entry__ as entry

    con = duckdb.connect()
    for t in ("lineitem", "orders"):
        con.execute(f"create view {t} as select * from '/root/testdata/sf0.001/{t}.parquet'")
    want = con.execute(entry.oracle_sql()[name])
    names = [d[0] for d in want.description]
    got = entry.queries()[name](spark, "/root/testdata/sf0.001").select(names).collect()
    assert "image_id" in names and sorted(map(tuple, got)) == sorted(want.fetchall())


def test_tasks_of_the_wide_panel_follow_the_lines(spark, monkeypatch):
    from scoreloom.plans import tables

    monkeypatch.setattr(tables, "LINES_PER_TASK", 500)
    t = tables.Tables(spark, "/root/testdata/sf0.001")
    assert t.panel_wide.rdd.getNumPartitions() >= 12
    wide = {(r.image_id, r.model, d, r[d]) for r in t.panel_wide.collect() for d in tables.DIMENSIONS}
    assert wide == {(r.image_id, r.model, r.dimension, r.score) for r in t.panel.collect()}
