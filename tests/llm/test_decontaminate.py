import random

from scoreloom.llm import decontaminate

from . import plain


def test_equals_brute_force(spark, table):
    rng = random.Random(3)
    make = lambda n, r=rng: " ".join(r.choice(["a", "b", "c", "É"]) + r.choice(["", ".", ","]) for _ in range(n))
    items = [(i, make(rng.choice([0, 1, 3, 7, 9, 10, 11, 14, 30]))) for i in range(7, 19)]
    items += [(5, None), (None, "a b"), (9, "zz yy xx ww vv uu tt ss rr qq pp"), (9, "zz yy xx ww vv uu tt ss rr qq pp")]
    docs = [(i, make(rng.randint(0, 60))) for i in range(200)] + [(900, None), (901, ""), (902, "ZZ yy xx-ww vv uu tt ss rr qq pp oo"), (902, "zz yy xx ww vv")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = decontaminate.spans(table(docs), bench)
    assert sorted((tuple(r)[:6] for r in decontaminate.digests(found).collect()), key=str) == plain.contaminated(docs, items)


def test_several_automata_and_cut(spark, table, monkeypatch):
    monkeypatch.setattr(decontaminate, "MOST_WORDS", 12)
    items = [(i, " ".join(f"i{i}w{k}" for k in range(12))) for i in range(5)]
    text = items[3][1]
    docs = [(1, f"start, {text}! end " + "and more words after it that no item has in this order at all"), (2, text), (3, "clean text"), (4, None)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert len(decontaminate.item_groups(bench, "item_id", "text", 12)) == 5
    assert {r.doc_id: r["items"] for r in decontaminate.spans(table(docs), bench).collect()} == {1: ["3"], 2: ["3"], 3: [], 4: []}
    kept = {r.doc_id: r.text for r in decontaminate.cut(table(docs), bench).collect()}
    assert kept == {1: "start, ! end and more words after it that no item has in this order at all", 3: "clean text", 4: None}
    assert decontaminate.cut(table([]), bench).count() == 0
    assert decontaminate.cut(table(docs), bench.limit(0)).count() == 4
