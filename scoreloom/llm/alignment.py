"""Alignment of two tokenizers' tokens by products of sparse incidence matrices.

The rows of a token-byte matrix are tokens, its columns the bytes they cover. Row products in
Gustavson's way (each entry of a row fetches a row of the other matrix, and what was fetched is
summed) give overlap links: A B' holds the bytes that an A token and a B token share. Where the
links of one A token end before those of the next begin, both tokenizers cut, and a new group
starts. Products of id-group matrices, with occurrences as values, give the shared-group links
of a text: how many pairs of occurrences an A id and a B id have in common groups.

Texts are handled in chunks of bounded size, joined end to end: both tokenizers cut between
texts, so no link crosses. Links are stored by id pair; the number of texts that hold a pair is
added up within tasks first. The table of pairs is sent to tasks in parts of ``PAIRS`` pairs,
each in a pass of its own over the stored links.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache, reduce
from itertools import chain

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .stages import written
from .textblocks import chunks

CHUNK_BYTES = 1 << 17
EXPANDED = 1 << 20  # products of entries at a time
# fixed value: how byte-level models with their standard pattern split a text before merging
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
PAIRS = 4_000_000  # id pairs sent to tasks at once, 17 bytes each
HELD = 500_000  # id pairs that a task adds up before it passes them on


@dataclass
class Csr:
    """Compressed sparse rows: row r has columns ``cols[edge[r]:edge[r + 1]]`` and values alike."""

    edge: np.ndarray
    cols: np.ndarray
    values: np.ndarray
    width: int

    def __len__(self) -> int:
        return len(self.edge) - 1

    def rows(self) -> np.ndarray:
        return np.repeat(np.arange(len(self)), np.diff(self.edge))

    def turned(self) -> Csr:
        order = np.argsort(self.cols, kind="stable")
        return Csr(np.concatenate(([0], np.cumsum(np.bincount(self.cols, minlength=self.width)))).astype(np.int64), self.rows()[order], self.values[order], len(self))


def csr(rows: np.ndarray, cols: np.ndarray, values: np.ndarray, height: int, width: int) -> Csr:
    """Entries in any order; those in one place are summed."""
    place = rows * width + cols
    if len(place) and (place[1:] < place[:-1]).any():
        order = np.argsort(place, kind="stable")
        place, values = place[order], values[order]
    first = np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1]))) if len(place) else np.zeros(0, np.int64)
    total = np.add.reduceat(values, first) if len(first) else values[:0]
    at, to = np.divmod(place[first], max(width, 1))
    return Csr(np.concatenate(([0], np.cumsum(np.bincount(at, minlength=height)))).astype(np.int64), to, total, width)


def incidence(edges: np.ndarray) -> Csr:
    """Tokens that cover bytes ``edges[i]:edges[i + 1]``."""
    n = int(edges[-1])
    return Csr(edges, np.arange(n), np.ones(n, np.int64), n)


def product(x: Csr, y: Csr) -> Csr:
    """x y by rows: entry (r, k) of x fetches row k of y. At most ``EXPANDED`` products, or one row's, at a time."""
    each = y.edge[x.cols + 1] - y.edge[x.cols]
    done = np.concatenate(([0], np.cumsum(each)))
    work = done[x.edge]
    parts, lo = [], 0
    while lo < len(x):
        hi = max(lo + 1, int(np.searchsorted(work, work[lo] + EXPANDED, side="right")) - 1)
        a, b = x.edge[lo], x.edge[hi]
        n = each[a:b]
        fetched = np.repeat(y.edge[x.cols[a:b]] - (done[a:b] - done[a]), n) + np.arange(int(n.sum()))
        rows = np.repeat(np.repeat(np.arange(hi - lo), np.diff(x.edge[lo:hi + 1])), n)
        parts.append(csr(rows, y.cols[fetched], np.repeat(x.values[a:b], n) * y.values[fetched], hi - lo, y.width))
        lo = hi
    if not parts:
        return Csr(np.zeros(1, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), y.width)
    before = np.cumsum([0, *(int(p.edge[-1]) for p in parts)])
    edge = np.concatenate([[0], *(p.edge[1:] + b for p, b in zip(parts, before[:-1], strict=True))])
    return Csr(edge.astype(np.int64), np.concatenate([p.cols for p in parts]), np.concatenate([p.values for p in parts]), y.width)


def overlap_links(a_edges: np.ndarray, b_edges: np.ndarray) -> Csr:
    """Shared bytes of every A token (row) and B token (column)."""
    return product(incidence(a_edges), incidence(b_edges).turned())


def groups(links: Csr, n_b: int) -> tuple[np.ndarray, np.ndarray]:
    """Group of every A and every B token; a group starts where no overlap link crosses."""
    first, last = links.cols[links.edge[:-1]], links.cols[links.edge[1:] - 1]
    of_a = np.cumsum(np.concatenate(([0], (first[1:] > last[:-1]).astype(np.int64)))) if len(first) else np.zeros(0, np.int64)
    of_b = np.zeros(n_b, np.int64)
    of_b[links.cols] = of_a[links.rows()]
    return of_a, of_b


def shared_group_links(a_ids: np.ndarray, a_groups: np.ndarray, b_ids: np.ndarray, b_groups: np.ndarray, n_groups: int, n_b_ids: int) -> tuple[np.ndarray, Csr]:
    """Distinct A ids, and how often each shares a group with each B id (pairs of occurrences)."""
    names, row = np.unique(a_ids, return_inverse=True)
    x = csr(row, a_groups, np.ones(len(row), np.int64), len(names), n_groups)
    y = csr(b_groups, b_ids, np.ones(len(b_ids), np.int64), n_groups, n_b_ids)
    return names, product(x, y)


class Tokenizers:
    """A: byte-level BPE of the tokenizers library. B: a sentencepiece model with a blank prefix."""

    def __init__(self, a_path: str, b_path: str):
        import sentencepiece
        from tokenizers import Tokenizer

        self.a, self.b = Tokenizer.from_file(a_path), sentencepiece.SentencePieceProcessor(model_file=b_path)
        self.a.encode_special_tokens = True  # their strings in a text are ordinary text
        # the printable stand-ins of bytes in byte-level vocabularies: a byte that prints stands for itself, others from 256 on
        prints = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        others = [b for b in range(256) if b not in prints]
        byte_of = {chr(b): b for b in prints} | {chr(256 + i): b for i, b in enumerate(others)}
        self.n_a, self.n_b = self.a.get_vocab_size(), self.b.get_piece_size()
        spell = lambda t: bytes(byte_of[c] for c in t) if all(c in byte_of for c in t) else t.encode()
        self.a_bytes = [spell(self.a.id_to_token(i) or "") for i in range(self.n_a)]
        self.b_bytes = [bytes([int(self.b.id_to_piece(i)[3:5], 16)]) if self.b.is_byte(i) else self.b.id_to_piece(i).replace("▁", " ").encode() for i in range(self.n_b)]
        self.a_sizes, self.b_sizes = np.array([len(x) for x in self.a_bytes]), np.array([len(x) for x in self.b_bytes])
        self.fast = self._merges(a_path)
        if self.fast:
            self.a = None  # its tables would stay in every worker
        # ids as text with what follows: , or | after an A id, , or ; after a B id
        self.said = [b"%d%s" % (i, end) for n, ends in ((self.n_a, b",|"), (self.n_b, b",;")) for end in (ends[:1], ends[1:]) for i in range(n)]

    def _merges(self, path: str):
        """The model of the file in a library that is faster at the same merges; None where the file
        has another kind of model, or merges out of the order of ids."""
        import json

        import tiktoken

        with open(path, encoding="utf-8") as f:
            kind = json.load(f)
        model, split = kind["model"], kind["pre_tokenizer"] or {}
        plain = model["type"] == "BPE" and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
        whole = split.get("type") == "ByteLevel" and split.get("use_regex") and not split.get("add_prefix_space") and kind["normalizer"] is None
        added = {t["id"] for t in kind["added_tokens"]}
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        if not plain or not whole or any(model["vocab"].get(a + b) != 256 + i for i, (a, b) in enumerate(pairs)) or len(set(model["vocab"].values()) - added) != 256 + len(pairs):
            return None
        return tiktoken.Encoding("a", pat_str=SPLIT, mergeable_ranks={b: i for i, b in enumerate(self.a_bytes) if i not in added}, special_tokens={})

    def encode(self, texts: list[str]) -> tuple[list, list]:
        """Ids of both, empty for texts whose tokens don't spell a blank and the text."""
        if self.fast:
            a = [self.fast.encode_ordinary(" " + t) for t in texts]
        else:
            a = [e.ids for e in self.a.encode_batch([" " + t for t in texts], add_special_tokens=False)]
        b = self.b.encode(texts, num_threads=1) if texts else []
        for i, t in enumerate(texts):
            want = b" " + t.encode()
            if not t or b"".join(map(self.a_bytes.__getitem__, a[i])) != want or b"".join(map(self.b_bytes.__getitem__, b[i])) != want:
                a[i], b[i] = [], []
        return a, b


@lru_cache(maxsize=2)
def tokenizers(a_path: str, b_path: str) -> Tokenizers:
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    return Tokenizers(a_path, b_path)


@dataclass
class Aligned:
    """One text: ids, groups, digest, and its links by sorted key ``a id * B's vocabulary + b id``."""

    a_ids: np.ndarray
    b_ids: np.ndarray
    a_groups: np.ndarray
    b_groups: np.ndarray
    spelled: bytes
    keys: np.ndarray
    times: np.ndarray


def align(tools: Tokenizers, texts: list[str]) -> Iterator[Aligned]:
    """Every text in turn; the overlap and group products run over all of them at once."""
    ids_a, ids_b = tools.encode(texts)
    a, b = (np.fromiter(chain.from_iterable(lists), np.int64, sum(map(len, lists))) for lists in (ids_a, ids_b))
    first_a, first_b = np.cumsum([0, *map(len, ids_a)]), np.cumsum([0, *map(len, ids_b)])
    links = overlap_links(np.concatenate(([0], np.cumsum(tools.a_sizes[a]))), np.concatenate(([0], np.cumsum(tools.b_sizes[b]))))
    group_a, group_b = groups(links, len(b))
    n_groups = int(group_a[-1]) + 1 if len(a) else 0
    text_of = np.repeat(np.arange(len(texts)), np.diff(first_a))
    names, shared = shared_group_links(text_of * tools.n_a + a, group_a, b, group_b, n_groups, tools.n_b)
    text_of_row, name = np.divmod(names, tools.n_a)
    keys = name[shared.rows()] * tools.n_b + shared.cols
    edge = shared.edge[np.searchsorted(text_of_row, np.arange(len(texts) + 1))]
    # ids in the order of groups, A's before B's, each with the mark that follows it
    ends_a, ends_b = np.append(group_a[1:] != group_a[:-1], True)[:len(a)], np.append(group_b[1:] != group_b[:-1], True)[:len(b)]
    order = np.argsort(np.concatenate((group_a * 2, group_b * 2 + 1)), kind="stable")
    marks = np.concatenate((a + ends_a * tools.n_a, 2 * tools.n_a + b + ends_b * tools.n_b))[order].tolist()
    for i in range(len(texts)):
        pa_, pb, at, n = slice(first_a[i], first_a[i + 1]), slice(first_b[i], first_b[i + 1]), slice(edge[i], edge[i + 1]), first_a[i] + first_b[i]
        spelled = b"".join(map(tools.said.__getitem__, marks[n:first_a[i + 1] + first_b[i + 1]]))[:-1]
        start = group_a[first_a[i]] if first_a[i] < first_a[i + 1] else 0
        yield Aligned(a[pa_], b[pb], group_a[pa_] - start, group_b[pb] - start, spelled, keys[at], shared.values[at])


def _packed(values: np.ndarray) -> bytes:
    """Bytes of equal weight together, compressed."""
    return zstandard.compress(np.ascontiguousarray(values.astype(np.int64).view(np.uint8).reshape(-1, 8).T).tobytes(), 1)


def _unpacked(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(data), np.uint8).reshape(8, -1)
    return np.ascontiguousarray(planes.T).view(np.int64).ravel()


def links(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The id column, then n_a, n_b, n_groups, n_links, groups_sha256, and the links: keys, times (packed).

    A null or empty text, and one whose tokens spell something else than a blank and the text, has zeros and
    an empty digest. Every row stands for itself, repeated and null ids too. Very long texts are aligned whole.
    Extra columns play no part; an empty table gives no rows.
    """
    kind = docs.select(id_col).withColumns({c: F.lit(0).cast("long") for c in ("n_a", "n_b", "n_groups", "n_links")} | {"groups_sha256": F.lit(""), "keys": F.lit(b""), "times": F.lit(b"")}).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tools = tokenizers(a_path, b_path)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for lo, hi in chunks(texts, CHUNK_BYTES):
                rows = [(len(x.a_ids), len(x.b_ids), int(x.a_groups[-1]) + 1 if len(x.a_ids) else 0, int(x.times.sum()), hashlib.sha256(x.spelled).hexdigest() if len(x.a_ids) else "", _packed(x.keys), _packed(x.times)) for x in align(tools, texts[lo:hi])]
                columns = zip(*rows, strict=True)
                types = [pa.int64()] * 4 + [pa.string(), pa.binary(), pa.binary()]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], names=kind.names)

    return docs.select(id_col, text_col).mapInArrow(run, kind)


def pair_counts(stored: DataFrame) -> DataFrame:
    """key, docs: the number of texts that hold each id pair linked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, docs, fresh, n = np.zeros(0, np.int64), np.zeros(0, np.int64), [], 0
        out = lambda: pa.RecordBatch.from_arrays([pa.array(keys), pa.array(docs)], names=["key", "docs"])
        for batch in batches:
            for data in batch.column(0).to_pylist():
                fresh.append(_unpacked(data))
                n += len(fresh[-1])
                if n > HELD:
                    keys, docs, fresh, n = *_added(keys, docs, fresh), [], 0
                    if len(keys) > HELD:
                        yield out()
                        keys, docs = keys[:0], docs[:0]
        keys, docs = _added(keys, docs, fresh)
        yield out()

    return stored.select("keys").mapInArrow(run, "key long, docs long").groupBy("key").agg(F.sum("docs").alias("docs"))


def _added(keys: np.ndarray, docs: np.ndarray, fresh: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    more, times = np.unique(np.concatenate(fresh), return_counts=True) if fresh else (keys[:0], docs[:0])
    both = csr(np.zeros(len(keys) + len(more), np.int64), np.concatenate((keys, more)), np.concatenate((docs, times)), 1, 1 << 62)
    return both.cols, both.values


def digests(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``links`` by number, with n_best (links whose pair more or as many texts hold than any other pair of the A id) and count_sum."""
    stored = written(links(docs, a_path, b_path, id_col, text_col).withColumn("row", F.monotonically_increasing_id()), "links")
    n_b = tokenizers(a_path, b_path).n_b
    table = written(pair_counts(stored), "pairs")
    a = F.floor(F.col("key") / n_b)
    best = table.groupBy(a.alias("a")).agg(F.max("docs").alias("most"))
    table = written(table.withColumn("a", a).join(best, "a").select("key", "docs", (F.col("docs") == F.col("most")).alias("best")), "pairs")
    parts = max(1, -(-table.count() // PAIRS))
    kept = [f for f in stored.columns if f not in ("keys", "times")]
    sums = [_summed(stored, table.where(F.pmod(F.xxhash64("key"), F.lit(parts)) == part) if parts > 1 else table, kept) for part in range(parts)]
    if parts == 1:
        return sums[0].drop("row")
    whole = reduce(DataFrame.unionAll, sums).groupBy("row").agg(*[F.first(c).alias(c) for c in kept if c != "row"], F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    return whole.drop("row")


def _summed(stored: DataFrame, part: DataFrame, kept: list[str]) -> DataFrame:
    """The kept columns, n_best and count_sum over the pairs of one part."""
    rows = part.toPandas().sort_values("key")  # about PAIRS rows
    sent = stored.sparkSession.sparkContext.broadcast((rows["key"].to_numpy(np.int64), rows["docs"].to_numpy(np.int64), rows["best"].to_numpy(bool)))
    kind = stored.select(*kept).withColumns({"n_best": F.lit(0).cast("long"), "count_sum": F.lit(0).cast("long")}).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, docs, best = sent.value
        for batch in batches:
            n_best, total = [], []
            for k, t in zip(batch.column(len(kept)), batch.column(len(kept) + 1), strict=True):
                k, t = _unpacked(k.as_py()), _unpacked(t.as_py())
                if len(keys):
                    at = np.minimum(np.searchsorted(keys, k), len(keys) - 1)
                    t = t * (keys[at] == k)
                else:
                    at, t = np.zeros(0, np.int64), t[:0]
                n_best.append(int(t[best[at]].sum()))
                total.append(int((t * docs[at]).sum()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:len(kept)], pa.array(n_best, pa.int64()), pa.array(total, pa.int64())], names=kind.names)

    return stored.select(*kept, "keys", "times").mapInArrow(run, kind)
