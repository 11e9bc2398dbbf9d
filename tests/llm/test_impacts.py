import math
import random
from collections import Counter

import duckdb
import numpy as np
import pytest

from scoreloom.llm import catalogue, impacts

from . import plain

SF = "/root/testdata/sf0.001"


def plainly(docs, items, k):
    terms = {i: Counter(plain.ALNUM_ALL.findall(plain.lower(t))) for i, t in enumerate(t for _, t in docs)}
    n_texts, n_all = sum(bool(c) for c in terms.values()), sum(sum(c.values()) for c in terms.values())
    df = Counter(t for c in terms.values() for t in c)
    asked = {}
    for i, t in items:
        if i is not None:
            asked.setdefault(i, set()).update(plain.ALNUM_ALL.findall(plain.lower(t)))
    out = []
    for item, wanted in asked.items():
        found = []
        for i, (d, _) in enumerate(docs):
            n = sum(terms[i].values())
            m = 10 + 90 * n * n_texts // n_all if n_all else 0
            score = sum(math.floor(1000 * math.log((2 * n_texts + 2) / (2 * df[t] + 1))) * (10**9 * terms[i][t] // (1000 * terms[i][t] + 8 * m)) for t in wanted if t in terms[i])
            if score > 0 and d is not None:
                found.append((-score, d))
        out += [(item, r + 1, d, -s) for r, (s, d) in enumerate(sorted(found)[:k])]
    return sorted(out)


def test_equals_plain_scores(spark, table, monkeypatch):
    monkeypatch.setattr(impacts, "BUCKET", 8)
    monkeypatch.setattr(impacts, "PAIRS", 60)  # several groups of items
    rng = random.Random(8)
    words = [f"w{i}" for i in range(40)] + ["Ä", "É1", "x_y", "A-B"]
    draw = lambda n: " ".join(rng.choice(words[: rng.randint(5, len(words))]) for _ in range(n))
    docs = [(i, draw(rng.choice((0, 1, 5, 30, 80)))) for i in range(150)] + [(7, draw(20)), (None, draw(20)), (300, None), (301, ""), (302, "--"), (303, "w1 " * 30000)]
    docs += [(i, "w1 w2 same text") for i in range(400, 420)]
    items = [(i, draw(rng.randint(0, 12))) for i in range(25)] + [(3, "w2 w2"), (None, "w1"), (90, None), (91, "same TEXT"), (92, "none such")]
    got = impacts.search(table(docs), table(items).withColumnRenamed("doc_id", "item_id"), 5)
    assert sorted(map(tuple, got.collect())) == plainly(docs, items, 5)


def test_equals_sql(spark):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    want = con.execute(catalogue.ORACLES["op12_impacts"])
    names = [d[0] for d in want.description]
    got = catalogue.QUERIES["op12_impacts"](spark, SF).select(*names)
    assert sorted(map(tuple, got.collect())) == sorted(want.fetchall())


@pytest.mark.parametrize(("docs", "items"), [([], [(1, "a")]), ([(1, "a")], []), ([(1, "a")], [(1, "b")]), ([(1, None)], [(1, None)])])
def test_nothing_found(table, docs, items):
    assert impacts.search(table(docs), table(items).withColumnRenamed("doc_id", "item_id")).count() == 0


def test_bounds_spare_texts():
    rng = np.random.default_rng(2)
    items = impacts.Items(np.repeat(np.arange(4), 6), rng.permuted(np.tile(np.arange(60), (4, 1)), axis=1)[:, :6].ravel(), rng.integers(1, 5000, 24))
    best = impacts.Best(items, 3)
    for scale in (1000, 300, 100, 10):
        terms = [np.sort(rng.permutation(60)[:10]).astype(np.int32).tobytes() for _ in range(200)]
        values = [rng.integers(1, 9, 10).astype(np.int32) * scale for _ in range(200)]
        best.take(impacts.Bucket(np.arange(200) + scale * 1000, np.array([np.sqrt((v.astype(float) ** 2).sum()) for v in values]), terms, [v.astype(np.int32).tobytes() for v in values]))
    assert best.scored <= 4 * 800 / 4  # the longest bucket alone
