import random

import public_tokenizers
import sentencepiece

from scoreloom.llm import pieces

MODEL = public_tokenizers.path("piece_bpe_32k.model")
TEXTS = ["", " ", "  a  b", "a\nb\t c", "é中😀", "▁x", "<s>a</s>", "<0x41>", "a\0b", "\n", "　 x", "�", "a" * 700, " " * 77 + "x" + " " * 35, "͸͸", "abababab" * 20]


def test_equals_the_library():
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    coder, rng = pieces.Encoder(MODEL), random.Random(1)
    texts = list(TEXTS)
    for letters, n in (("abctheing   ▁éè中文字\n\t.,!0123", 3000), ("ab <>0x", 500)):
        texts += ["".join(rng.choice(letters) for _ in range(rng.randint(1, 60))) for _ in range(n)]
    texts += ["".join(chr(rng.choice([rng.randint(1, 0x2FF), rng.randint(0x2500, 0x9FFF), rng.randint(0x1F300, 0x1F6FF)])) for _ in range(rng.randint(1, 40))) for _ in range(500)]
    got, want = coder.encode(texts), [library.encode(t, add_bos=True, add_eos=True) for t in texts]
    assert [g.tolist() for g in got] == want
    assert [coder.decode(g) for g in got] == [library.decode(w) for w in want]


def test_full_memory_is_emptied(monkeypatch):
    monkeypatch.setattr(pieces, "MEMORY", 5)
    coder = pieces.Encoder(MODEL)
    texts = ["one two three four five six", "six seven", "eight one two", "nine ten eleven twelve"]
    fresh = pieces.Encoder(MODEL)
    assert [x.tolist() for t in texts for x in coder.encode([t])] == [x.tolist() for x in fresh.encode(texts)]


def test_tables(table):
    rows = {r.doc_id: r for r in pieces.encode_decode(table([(1, None), (2, "x y"), (3, "")]), MODEL).collect()}
    assert rows[1].ids == [1, 2] and rows[1].decoded == "" and rows[2].decoded == "x y"
    assert pieces.digests(table([]), MODEL).count() == 0 and pieces.digests(table([(2, "x"), (2, "x")]), MODEL).count() == 2
