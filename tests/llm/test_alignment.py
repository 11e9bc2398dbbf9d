import random
from collections import Counter

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from scoreloom.llm import alignment

from . import plain

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def dense(m):
    out = np.zeros((len(m), m.width), np.int64)
    out[m.rows(), m.cols] = m.values
    return out


def test_products_equal_dense_ones(monkeypatch):
    monkeypatch.setattr(alignment, "EXPANDED", 7)
    rng = np.random.default_rng(1)
    for _ in range(60):
        h, k, w = rng.integers(0, 9, 3)
        draw = lambda a, b: alignment.csr(*(rng.integers(0, max(n, 1), 12 if a and b else 0) for n in (a, b)), rng.integers(1, 5, 12 if a and b else 0), a, b)
        x, y = draw(h, k), draw(k, w)
        assert (dense(alignment.product(x, y)) == dense(x) @ dense(y)).all()
        assert (dense(x.turned()) == dense(x).T).all()


def cuts(sizes):
    return np.cumsum([0, *sizes])


def test_overlaps_and_groups_by_hand():
    links = alignment.overlap_links(cuts([2, 3, 1, 4]), cuts([1, 4, 2, 3]))
    assert dense(links).tolist() == [[1, 1, 0, 0], [0, 3, 0, 0], [0, 0, 1, 0], [0, 0, 1, 3]]
    assert [x.tolist() for x in alignment.groups(links, 4)] == [[0, 0, 1, 1], [0, 0, 1, 1]]


def slowly():
    tool = Tokenizer.from_file(A)
    tool.encode_special_tokens = True
    return tool


def plainly(tools, docs):
    whole = slowly()
    parts, holders, out = [], Counter(), []
    for _, t in docs:
        t = t or ""
        a, b = whole.encode(" " + t, add_special_tokens=False).ids, tools.b.encode(t)
        a_bytes, b_bytes = [tools.a_bytes[i] for i in a], [tools.b_bytes[i] for i in b]
        if not t or b"".join(a_bytes) != (" " + t).encode() or b"".join(b_bytes) != (" " + t).encode():
            parts.append(None)
            continue
        ends = sorted(set(cuts(map(len, a_bytes)).tolist()) & set(cuts(map(len, b_bytes)).tolist()))
        of = lambda ids, sizes: [sum(e <= s for e in ends) for s in cuts(sizes)[:-1].tolist()]  # noqa: E731, B023
        ga, gb = of(a, map(len, a_bytes)), of(b, map(len, b_bytes))
        groups = [([i for i, g in zip(a, ga) if g == n], [i for i, g in zip(b, gb) if g == n]) for n in range(1, len(ends))]
        pairs = Counter((x, y) for xs, ys in groups for x in xs for y in ys)
        holders.update(pairs.keys())
        parts.append((len(a), len(b), groups, pairs))
    most = {}
    for (a, _), n in holders.items():
        most[a] = max(most.get(a, 0), n)
    for (d, _), p in zip(docs, parts):
        if p is None:
            out.append((d, 0, 0, 0, 0, 0, 0, ""))
            continue
        n_a, n_b, groups, pairs = p
        spelled = ";".join(",".join(map(str, xs)) + "|" + ",".join(map(str, ys)) for xs, ys in groups)
        out.append((d, n_a, n_b, len(groups), pairs.total(), sum(n for k, n in pairs.items() if holders[k] == most[k[0]]), sum(n * holders[k] for k, n in pairs.items()), plain.sha(spelled)))
    return sorted(out, key=str)


def test_equals_brute_force(table, spark, monkeypatch):
    monkeypatch.setattr(alignment, "CHUNK_BYTES", 3000)
    monkeypatch.setattr(alignment, "HELD", 500)
    rng = random.Random(6)
    words = "the of to Zugeü $$$ ñezll don't 12345 <|endoftext|> <s> é é ▁ 𝔸 naïve 東京都 \t \n  ﬁx aaaaaaaaaaaaaaaa .,;| \x00".split(" ")
    docs = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(0, 40)))) for i in range(80)]
    docs += [(100, None), (101, ""), (102, " "), (7, "the of"), (7, "the of"), (None, "of the"), (103, "▁"), (104, " lead"), (105, "the naïve 12 " * 3000), (106, "a" * 3000)]
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").limit(30).collect()]
    docs += [(i + 1000, t[:2000]) for i, t in rows]
    want = plainly(alignment.tokenizers(A, B), docs)
    columns = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    got = alignment.digests(table(docs), A, B).select(*columns)
    assert sorted(map(tuple, got.collect()), key=str) == want
    monkeypatch.setattr(alignment, "PAIRS", 200)  # the table of pairs in several parts
    assert sorted(map(tuple, alignment.digests(table(docs), A, B).select(*columns).collect()), key=str) == want


def test_no_rows(table):
    assert alignment.digests(table([]), A, B).count() == 0
    assert alignment.digests(table([(1, None)]), A, B).first().groups_sha256 == ""


def test_both_libraries_merge_alike(spark):
    """Every code point between, before and after letters, digits, blanks and marks of its own kind."""
    tools = alignment.tokenizers(A, B)
    assert tools.fast is not None
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    points = points[:0x3000] + points[0x3000::23]
    texts = [f"a{chr(c)}b {chr(c)}1{chr(c)} {chr(c)}{chr(c)}  {chr(c)}s'{chr(c)}ll" for c in points]
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()
    texts += [r.text for r in rows if r.text] + ["<|endoftext|>", "a" * 5000, " " * 3000, "don't we'll I'D"]
    slow = slowly().encode_batch(texts, add_special_tokens=False)
    assert all(tools.fast.encode_ordinary(t) == e.ids for t, e in zip(texts, slow))
