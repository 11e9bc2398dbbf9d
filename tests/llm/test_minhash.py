import random

from scoreloom.llm import components, minhash

from . import plain


def groups(docs, **how):
    return sorted(tuple(r) for r in minhash.groups(docs, **how).select("id", "n_shingles", "component").collect())


def test_equals_brute_force(table, monkeypatch):
    monkeypatch.setattr(minhash, "HOT_FROM", 20)
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(400)]
    base = [[rng.choice(vocabulary) for _ in range(n)] for n in (30, 60, 100, 200, 700)]
    hot = " ".join(rng.choice(vocabulary) for _ in range(25))
    docs = []
    for i in range(350):
        words = list(rng.choice(base))
        for _ in range(rng.randint(0, max(1, len(words) // 25))):
            words[rng.randrange(len(words))] = rng.choice(vocabulary)
        docs.append((i, " ".join(words)))
    docs += [(i, hot + " " + " ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 90)))) for i in range(700, 850)]
    docs += [(1000, None), (1001, ""), (1002, "a"), (1003, "A"), (1004, "a b"), (1005, " a\tB ")]
    rng.shuffle(docs)
    docs = [(i * 3 - 500, t) for i, t in docs]
    assert groups(table(docs), size=3, percent=85) == plain.near_groups(docs, 3, 85)


def test_one_of_each(table):
    a = " ".join(f"w{i}" for i in range(200))
    docs = table([(4, a), (2, a + " x"), (2, a + " x"), (7, "other words"), (None, a), (9, None), (10, "")])
    assert sorted((r.doc_id for r in minhash.one_of_each(docs).collect()), key=str) == sorted([2, 7, None, 9, 10], key=str)
    assert minhash.one_of_each(table([])).count() == 0 and minhash.groups(table([])).count() == 0


def test_components(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 50), (50, 100), (7, 7), (200, 300), (None, 1), (300, 250)]
    got = {r.id: r.component for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 50, 50: 50, 200: 200, 300: 200, 250: 200}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_one_template_in_many_texts(table):
    rng = random.Random(8)
    template = " ".join(f"t{i}" for i in range(40))
    own = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    docs = [(i, template + " " + own(rng.choice((2, 5, 20, 60)))) for i in range(2000)]
    assert groups(table(docs), size=3, percent=85) == plain.near_groups(docs, 3, 85)


def test_low_part_holds_what_a_cool_sketch_needs():
    for percent in (60, 80, 85, 95):
        for n in range(1, 600):
            low = minhash.low_size(n, percent)
            if minhash.prefix_size(n, percent) <= minhash.LOW_MOST:
                assert not minhash.beyond_low(n, low, 0, percent)
    assert minhash.beyond_low(100, 24, 12, 85) and not minhash.beyond_low(100, 24, 4, 85) and not minhash.beyond_low(0, 0, 0, 85)
