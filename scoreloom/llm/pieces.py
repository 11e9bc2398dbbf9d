"""SentencePiece BPE encoding and decoding by vectorised merge rounds.

All words of a batch lie in flat numpy symbol arrays. In a round every word takes the
smallest rank among its neighbouring pairs and merges the leftmost such pair, and all
later ones of the same pair at once where that can't change the result; the arrays are
then compacted. Rounds end when no word has a pair. Equal words are merged once.

A merged piece is *open* if a better-ranked piece starts or ends with it: merging the
leftmost pair may then bring up a pair that has to go first, so such pairs merge one at
a time. Words end before a blank mark that follows another character; the vocabulary
has no piece across that edge (checked when the vocabulary is loaded).
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .textblocks import byte_values, chunks

BLANK = "▁"
NONE = np.int64(1 << 62)
MEMORY = 500_000  # words kept between batches; a full memory is emptied


class Vocabulary:
    """Pieces, ranks and the pair table of one model file (identity normaliser, BPE, byte
    fallback, blank prefix; others are refused)."""

    def __init__(self, path: str):
        import sentencepiece

        m = sentencepiece.SentencePieceProcessor(model_file=path)
        n = m.get_piece_size()
        self.pieces = [m.id_to_piece(i) for i in range(n)]
        special = np.array([m.is_control(i) or m.is_unknown(i) or m.is_byte(i) for i in range(n)])
        self.special, self.bos, self.eos = special, m.bos_id(), m.eos_id()
        self.byte_of = np.full(n, -1, np.int64)
        for i in range(n):
            if m.is_byte(i):
                self.byte_of[i] = int(self.pieces[i][3:5], 16)
        self.id_of_byte = np.zeros(256, np.int64)
        self.id_of_byte[self.byte_of[self.byte_of >= 0]] = np.flatnonzero(self.byte_of >= 0)
        probe = " a　  éb\t"
        if any(m.is_unused(i) for i in range(n)) or (self.byte_of >= 0).sum() != 256 or m.decode(m.encode(probe)) != probe or m.encode("a")[0] != m.piece_to_id(BLANK + "a"):
            raise ValueError(f"{path}: this kind of model isn't supported")
        known = {p: i for i, p in enumerate(self.pieces) if not special[i]}
        if any(BLANK in p.lstrip(BLANK) for p in known):
            raise ValueError(f"{path}: pieces cross words")
        score = {i: m.get_score(i) for i in known.values()}
        order = {s: r for r, s in enumerate(sorted(set(score.values()), reverse=True))}  # equal scores share a rank
        self.rank = np.full(n, NONE, np.int64)
        for i, s in score.items():
            self.rank[i] = order[s]
        # single characters beyond the vocabulary also are symbols; pieces are made of known parts only or of two characters
        self.chars = {p: i for p, i in known.items() if len(p) == 1}
        pairs: dict[int, int] = {}
        self.open = np.zeros(n, bool)
        for p, i in known.items():
            for k in range(1, len(p)):
                a, b = known.get(p[:k]), known.get(p[k:])
                for part in (a, b):
                    if part is not None and self.rank[part] >= self.rank[i]:
                        self.open[part] = True
                if a is not None and b is not None:
                    pairs[a * n + b] = i
                elif (a is None and k == 1) or (b is None and k == len(p) - 1):
                    raise ValueError(f"{path}: a piece has a character that is no piece")
        keys = np.fromiter(pairs, np.int64, len(pairs))
        into = np.fromiter(pairs.values(), np.int64, len(pairs))
        # open addressing: a slot for each pair, found in a few vectorised probes
        self.n, self.bits = n, int(np.ceil(np.log2(len(keys) * 4)))
        self.slots, self.into = np.full(1 << self.bits, -1, np.int64), np.zeros(1 << self.bits, np.int64)
        left, at = np.arange(len(keys)), self._slot(keys)
        while len(left):
            free = self.slots[at[left]] < 0
            self.slots[at[left[free]]] = keys[left[free]]
            done = self.slots[at[left]] == keys[left]
            self.into[at[left[done]]] = into[left[done]]
            left = left[~done]
            at[left] = (at[left] + 1) & ((1 << self.bits) - 1)
        spelled = [p.replace(BLANK, " ").encode() if b < 0 else bytes([b]) for p, b in zip(self.pieces, self.byte_of.tolist(), strict=True)]
        self.spoken = ~special | (self.byte_of >= 0)
        self.letters, self.letter_edge = np.frombuffer(b"".join(spelled), np.uint8), np.cumsum([0, *map(len, spelled)])

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def pair(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Piece of each pair, -1 for none."""
        keys = np.where((a >= 0) & (b >= 0), a * self.n + b, -2)
        at, out = self._slot(keys), np.full(len(keys), -1, np.int64)
        todo = np.flatnonzero(keys >= 0)
        while len(todo):
            found = self.slots[at[todo]]
            hit = found == keys[todo]
            out[todo[hit]] = self.into[at[todo[hit]]]
            todo = todo[~hit & (found >= 0)]
            at[todo] = (at[todo] + 1) & ((1 << self.bits) - 1)
        return out


@lru_cache(maxsize=4)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def merge_words(v: Vocabulary, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all words in turn, and how many each has. Symbols below zero are characters without a piece; they become bytes at the end."""
    text = "".join(words)
    code = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.int64)
    kinds, back = np.unique(code, return_inverse=True)
    symbol = np.array([v.chars.get(chr(c), -1 - int(c)) for c in kinds], np.int64)[back] if len(code) else np.zeros(0, np.int64)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    word = np.repeat(np.arange(len(words)), sizes)
    done_symbol, done_word = [], []
    last = np.append(word[1:] != word[:-1], True)
    made = np.where(last, -1, v.pair(symbol, np.append(symbol[1:], -1)))
    while len(symbol):
        rank = np.where(made >= 0, v.rank[made], NONE)
        first = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
        lengths = np.diff(np.append(first, len(word)))
        best = np.repeat(np.minimum.reduceat(rank, first), lengths)
        live = best < NONE
        if not live.all():  # words without a pair leave
            done_symbol.append(symbol[~live])
            done_word.append(word[~live])
            symbol, word, last, made, rank, best = symbol[live], word[live], last[live], made[live], rank[live], best[live]
            if not len(symbol):
                break
        hits = np.flatnonzero(rank == best)
        new_word = np.append(True, word[hits[1:]] != word[hits[:-1]])
        once = v.open[made[hits]]
        # in a run of touching pairs every second one stands back
        touch = np.append(False, (hits[1:] == hits[:-1] + 1)) & ~new_word
        run_start = np.maximum.accumulate(np.where(touch, 0, np.arange(len(hits))))
        take = ((np.arange(len(hits)) - run_start) % 2 == 0) & (new_word | ~once)
        at = hits[take]
        symbol[at] = made[at]
        last[at] = last[at + 1]
        keep = np.ones(len(symbol), bool)
        keep[at + 1] = False
        place = np.cumsum(keep)[at] - 1
        symbol, word, last, made = symbol[keep], word[keep], last[keep], made[keep]
        made[place] = -1
        right = place[~last[place]]
        left = place[place > 0] - 1
        ask = np.concatenate((right, left[~last[left]]))  # only pairs beside a new piece are looked up again
        made[ask] = v.pair(symbol[ask], symbol[ask + 1])
    symbol, word = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (done_symbol, done_word))
    order = np.argsort(word, kind="stable")
    symbol, word = symbol[order], word[order]
    odd = np.flatnonzero(symbol < 0)
    if len(odd):  # byte fallback
        spelled = [v.id_of_byte[list(chr(-1 - c).encode())] for c in symbol[odd].tolist()]
        copies = np.ones(len(symbol), np.int64)
        copies[odd] = [len(x) for x in spelled]
        symbol, word = np.repeat(symbol, copies), np.repeat(word, copies)
        symbol[symbol < 0] = np.concatenate(spelled)
    return symbol.astype(np.uint32), np.bincount(word, minlength=len(words))


WORD = re.compile(f"{BLANK}*[^{BLANK}]+|{BLANK}+")


class Encoder:
    def __init__(self, path: str):
        self.v = vocabulary(path)
        self._forget()

    def _forget(self) -> None:
        self.number: dict[str, int] = {}
        self.ids, self.begin = np.zeros(0, np.uint32), np.zeros(1, np.int64)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids with begin and end, one array for each text."""
        split = [WORD.findall(BLANK + t.replace(" ", BLANK)) if t else [] for t in texts]
        words = list(chain.from_iterable(split))
        which = np.fromiter(map(self.number.get, words, repeat(-1)), np.int64, len(words))
        missing = np.flatnonzero(which < 0).tolist()
        fresh = list(dict.fromkeys(map(words.__getitem__, missing)))
        if len(self.number) + len(fresh) > MEMORY:
            self._forget()
            missing, fresh = range(len(words)), list(dict.fromkeys(words))
        if fresh:
            ids, sizes = merge_words(self.v, fresh)
            self.number.update(zip(fresh, range(len(self.number), len(self.number) + len(fresh)), strict=True))
            self.ids, self.begin = np.concatenate((self.ids, ids)), np.concatenate((self.begin, self.begin[-1] + np.cumsum(sizes)))
            which[missing] = [self.number[words[i]] for i in missing]
        sizes = self.begin[which + 1] - self.begin[which]
        edge = np.concatenate(([0], np.cumsum(sizes)))
        flat = self.ids[np.repeat(self.begin[which] - edge[:-1], sizes) + np.arange(edge[-1])]
        cuts = edge[np.cumsum([0, *map(len, split)])].tolist()
        first, last = np.array([self.v.bos], np.uint32), np.array([self.v.eos], np.uint32)
        return [np.concatenate((first, flat[a:b], last)) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids: blanks for blank marks, one leading blank less, bytes joined to characters
        (U+FFFD for each byte that fits none), control ids silent."""
        v = self.v
        ids = ids[v.spoken[ids]]
        sizes = v.letter_edge[ids + 1] - v.letter_edge[ids]
        edge = np.cumsum(sizes)
        raw = v.letters[np.repeat(v.letter_edge[ids] - (edge - sizes), sizes) + np.arange(edge[-1] if len(ids) else 0)].tobytes()
        if len(ids) and v.byte_of[ids[0]] < 0 and raw[:1] == b" ":
            raw = raw[1:]
        try:
            return raw.decode()
        except UnicodeDecodeError:
            return single_marks(raw)


def single_marks(raw: bytes) -> str:
    """UTF-8 with one U+FFFD for every byte outside a whole character."""
    out, i = [], 0
    while i < len(raw):
        for k in (1, 2, 3, 4):
            try:
                out.append(raw[i:i + k].decode())
                i += k
                break
            except UnicodeDecodeError:
                continue
        else:
            out.append("�")
            i += 1
    return "".join(out)


def encode_decode(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, ids (array<int>) and decoded text of every whole text, begin and end ids included.

    Null text counts as empty: ids are begin and end, decoded is "". An empty table gives no
    rows; repeated rows each give one; other columns play no part.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Encoder(model)
        for batch in batches:
            texts = byte_values(batch.column(1))
            for lo, hi in chunks(texts):
                ids = coder.encode([t.decode() for t in texts[lo:hi]])
                flat = pa.array(np.concatenate(ids).astype(np.int32))
                edge = pa.array(np.cumsum([0, *map(len, ids)]).astype(np.int32))
                yield pa.RecordBatch.from_arrays([batch.column(0)[lo:hi], pa.ListArray.from_arrays(edge, flat), pa.array([coder.decode(x) for x in ids], pa.string())], names=[id_col, "ids", "decoded"])

    kind = docs.schema[id_col].dataType
    return docs.select(id_col, text_col).mapInArrow(run, T.StructType([T.StructField(id_col, kind), T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.StringType())]))


def digests(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Id, token count and digests of ids and decoded text; whole ids don't leave the task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Encoder(model)
        for batch in batches:
            texts, out = byte_values(batch.column(1)), []
            for lo, hi in chunks(texts):
                for ids in coder.encode([t.decode() for t in texts[lo:hi]]):
                    out.append((len(ids), hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest(), hashlib.sha256(coder.decode(ids).encode()).hexdigest()))
            n, a, b = zip(*out, strict=True) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())], names=[id_col, "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = docs.schema[id_col].dataType
    return docs.select(id_col, text_col).mapInArrow(run, T.StructType([T.StructField(id_col, kind), T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]))
