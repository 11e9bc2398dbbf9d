import random

import pytest

from scoreloom.llm import factors, repeats, suffixes

from . import plain


def mixed(rng, base, join, odd, n):
    docs = []
    for i in range(n):
        out = []
        for _ in range(rng.randint(0, 4)):
            b = rng.choice(base)
            a = rng.randrange(len(b))
            out += b[a:a + rng.randint(1, 300)]
            out += [odd(rng) for _ in range(rng.randint(0, 20))]
        docs.append((i, join(out)))
    rng.shuffle(docs)
    return [(i * 3 - 100, t) for i, t in docs]


@pytest.mark.parametrize("window, most", [(50, 4096), (8, 5)])
def test_factors_equal_brute_force(table, window, most):
    rng = random.Random(5)
    base = [[rng.choice("abcd") for _ in range(n)] for n in (30, 60, 200, 700)]
    docs = mixed(rng, base, " ".join, lambda r: r.choice(["a", f"z{r.randint(0, 1000)}"]), 100)
    docs += [(1000, None), (1001, ""), (1002, "a " * 300), (1003, "a " * 300 + "b " * 60), (1004, " \t ")]
    got = factors.digests(factors.duplicate_spans(table(docs), window=window, most=most))
    assert sorted(tuple(r)[:4] for r in got.collect()) == plain.repeated_words(docs, window)


@pytest.mark.parametrize("window, most", [(100, 4096), (12, 5)])
def test_suffixes_equal_brute_force(table, window, most):
    rng = random.Random(6)
    base = ["".join(rng.choice("abcé") for _ in range(n)) for n in (30, 120, 200, 900)]
    docs = mixed(rng, base, "".join, lambda r: r.choice("abcé"), 80)
    docs += [(1000, None), (1001, ""), (1002, "a" * 900), (1003, "a" * 300 + "b" * 200), (1004, "\0\0\0"), (1005, "xyz" * 200)]
    got = suffixes.digests(suffixes.duplicate_spans(table(docs), window=window, most=most))
    assert sorted(map(tuple, got.collect())) == plain.repeated_bytes(docs, window)


def test_suffix_order_and_common_prefixes(monkeypatch):
    rng = random.Random(1)
    for _ in range(30):
        monkeypatch.setattr(suffixes, "READ", rng.choice([3, 7, 50, 1 << 18]))
        letters = rng.choice([b"ab", b"abc", b"a", bytes(range(40))])
        segments = [bytes(rng.choice(letters) for _ in range(rng.randint(0, 30))) for _ in range(rng.randint(1, 20))]
        lcp, who, offset = suffixes.build(segments)
        want = sorted((s[o:], i) for i, s in enumerate(segments) for o in range(len(s) + 1))
        assert [segments[i][o:] for i, o in zip(who.tolist(), offset.tolist())] == [s for s, _ in want]
        common = [next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b))) for (a, _), (b, _) in zip(want, want[1:])]
        assert lcp.tolist() == [0, *common]


def test_ids_that_are_null_or_shared(table):
    text = " ".join(f"w{i}" for i in range(60))
    docs = table([(None, text), (1, text), (1, text), (1, text + " x"), (2, "short")])
    got = sorted(map(tuple, factors.digests(factors.duplicate_spans(docs)).select("doc_id", "n_words", "n_removed").collect()), key=str)
    assert got == [(1, 60, 60), (1, 60, 60), (1, 61, 60), (2, 1, 0), (None, 60, 0)]
    assert factors.duplicate_spans(table([])).count() == 0 and suffixes.duplicate_spans(table([])).count() == 0


def test_crowded_keys_are_dealt_out(spark, table):
    """With a bound of one segment a key, no key with several different segments reaches a finder whole."""
    passage = " ".join(f"p{i}" for i in range(30))
    docs = [(i, f"a{i} b{i} " * 20 + passage + f" c{i} d{i}" * 20) for i in range(40)]
    got = factors.digests(factors.duplicate_spans(table(docs), most=1))
    assert sorted(tuple(r)[:4] for r in got.collect()) == plain.repeated_words(docs, 50)
    assert repeats.MOST_SEGMENTS > 1
