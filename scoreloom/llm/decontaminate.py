"""Benchmark decontamination with a generalised suffix automaton of test items.

Items become word sequences; one automaton holds every stretch of words of all items.
Training words stream through it while the state tracks the longest stretch that ends
at the current word. Words outside the items' vocabulary reset the state, so only runs
of known words are walked. Where the stretch is at least as long as a window, the state
of the window tells which items hold it.

An automaton holds at most ``MOST_WORDS`` words, which bounds what is sent to the tasks;
more items become several automata, and texts pass through one after the other.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .textblocks import ALNUM_WORDS, Words, byte_values, chunks, covered

WINDOW = 10
MOST_WORDS = 2_000_000


class Automaton:
    """Suffix automaton of several word sequences. State 0 is the empty stretch."""

    def __init__(self, items: list[tuple[str, bytes]], window: int = WINDOW):
        words = Words([t for _, t in items], ALNUM_WORDS, lower=True)
        self.vocabulary, tokens = np.unique(words.hash, return_inverse=True)
        self.follow: list[dict[int, int]] = [{}]
        self.link, self.longest = [-1], [0]
        sequences = [tokens[a:b].tolist() for a, b in zip(words.first[:-1], words.first[1:], strict=True)]
        for sequence in sequences:
            last = 0
            for token in sequence:
                last = self._extend(last, token)
        self.names = sorted({name for name, _ in items})
        number = {name: i for i, name in enumerate(self.names)}
        self.sizes = sorted({min(window, len(s)) for s in sequences if s})
        self.holders: dict[tuple[int, int], set[int]] = defaultdict(set)
        for (name, _), sequence in zip(items, sequences, strict=True):
            size = min(window, len(sequence))
            if size:
                for at, state, length in self.walk(sequence):
                    if at >= size - 1:
                        self.holders[self.state_of(state, size), size].add(number[name])

    def _extend(self, last: int, token: int) -> int:
        follow, link, longest = self.follow, self.link, self.longest
        if token in follow[last]:  # another item has this stretch
            q = follow[last][token]
            return q if longest[q] == longest[last] + 1 else self._clone(last, token, q)
        new = len(follow)
        follow.append({})
        link.append(0)
        longest.append(longest[last] + 1)
        p = last
        while p >= 0 and token not in follow[p]:
            follow[p][token] = new
            p = link[p]
        if p >= 0:
            q = follow[p][token]
            link[new] = q if longest[q] == longest[p] + 1 else self._clone(p, token, q)
        return new

    def _clone(self, p: int, token: int, q: int) -> int:
        follow, link, longest = self.follow, self.link, self.longest
        copy = len(follow)
        follow.append(dict(follow[q]))
        link.append(link[q])
        longest.append(longest[p] + 1)
        link[q] = copy
        while p >= 0 and follow[p].get(token) == q:
            follow[p][token] = copy
            p = link[p]
        return copy

    def walk(self, tokens: list[int]) -> Iterator[tuple[int, int, int]]:
        """Place, state and length of the longest stretch of the items that ends there."""
        state = length = 0
        for at, token in enumerate(tokens):
            while state and token not in self.follow[state]:
                state = self.link[state]
                length = self.longest[state]
            state = self.follow[state].get(token, 0)
            length = length + 1 if state else 0
            yield at, state, length

    def state_of(self, state: int, size: int) -> int:
        """State of the last ``size`` words of a stretch."""
        while self.longest[self.link[state]] >= size:
            state = self.link[state]
        return state

    def hits(self, words: Words) -> Iterator[tuple[int, int, int]]:
        """First word, end and item of every window that occurs in the texts."""
        if not self.sizes or not len(words.hash):
            return
        at = np.searchsorted(self.vocabulary, words.hash)
        at[at == len(self.vocabulary)] = 0
        known = self.vocabulary[at] == words.hash
        edge = np.flatnonzero(np.append(True, (known[1:] != known[:-1]) | (words.doc[1:] != words.doc[:-1])))
        ends = np.append(edge[1:], len(known))
        for a, b in zip(edge.tolist(), ends.tolist(), strict=True):
            if not known[a] or b - a < self.sizes[0]:
                continue
            for i, state, length in self.walk(at[a:b].tolist()):
                for size in self.sizes:
                    if length >= size:
                        for item in self.holders.get((self.state_of(state, size), size), ()):
                            yield a + i + 1 - size, a + i + 1, item


def item_groups(benchmark: DataFrame, id_col: str, text_col: str, most: int) -> list[list[tuple[str, bytes]]]:
    """Items as (id, text), in groups of at most ``most`` words (a longer item makes its own)."""
    groups, total = [[]], 0
    rows = benchmark.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text")).distinct().orderBy("id", "text")
    for row in rows.toLocalIterator():
        size = len(row.text) // 2 + 1  # a bound of its words
        if groups[-1] and total + size > most:
            groups.append([])
            total = 0
        groups[-1].append((row.id, row.text.encode()))
        total += size
    return groups


def find(texts: list[bytes], automata: list[Automaton]) -> Iterator[tuple[Words, np.ndarray, list[set[str]]]]:
    """For chunks of texts: their words, which words are hit, and item ids of each text."""
    for lo, hi in chunks(texts):
        words = Words(texts[lo:hi], ALNUM_WORDS, lower=True)
        items: list[set[str]] = [set() for _ in range(hi - lo)]
        starts, ends = [], []
        for automaton in automata:
            for a, b, item in automaton.hits(words):
                starts.append(a)
                ends.append(b)
                items[words.doc[a]].add(automaton.names[item])
        yield words, covered(np.array(starts, int), np.array(ends, int), len(words.hash)), items


def _built(shared: list, window: int) -> list[Automaton]:
    return [Automaton(b.value, window) for b in shared]


def spans(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
          item_text: str = "text", window: int = WINDOW) -> DataFrame:
    """id, n_words, n_hit, items (sorted ids as strings) and spans (byte ranges of maximal hit runs) of every text.

    Null and empty texts have no words. Items without words, text or id hold no window;
    repeated item ids add their windows. Ties don't arise; other columns play no part.
    """
    shared = [docs.sparkSession.sparkContext.broadcast(g) for g in item_groups(benchmark, item_col, item_text, MOST_WORDS)]
    span = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automata = _built(shared, window)
        for batch in batches:
            n_words, n_hit, found, cuts = [], [], [], []
            for words, hit, items in find(byte_values(batch.column(1)), automata):
                n_words += words.counts.tolist()
                sums = np.concatenate(([0], np.cumsum(hit)))
                n_hit += (sums[words.first[1:]] - sums[words.first[:-1]]).tolist()
                found += [sorted(x) for x in items]
                cuts += byte_runs(words, hit)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()), pa.array(found, pa.list_(pa.string())), pa.array(cuts, span)], names=[id_col, "n_words", "n_hit", "items", "spans"])

    kind = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), *T._parse_datatype_string("n_words long, n_hit long, items array<string>, spans array<struct<begin:long,end:long>>").fields])
    return docs.select(id_col, text_col).mapInArrow(run, kind)


def byte_runs(words: Words, hit: np.ndarray) -> list[list[dict]]:
    """Byte ranges of maximal runs of hit words, for each text from its own begin."""
    out: list[list[dict]] = [[] for _ in words.counts]
    at = np.flatnonzero(hit)
    if len(at):
        new = np.append(True, (at[1:] != at[:-1] + 1) | (words.doc[at[1:]] != words.doc[at[:-1]]))
        first, last = at[new], at[np.append(new[1:], True)]
        for a, b in zip(first.tolist(), last.tolist(), strict=True):
            d = words.doc[a]
            out[d].append({"begin": int(words.start[a] - words.bytes.begin[d]), "end": int(words.end[b] - words.bytes.begin[d])})
    return out


def cut(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text",
        window: int = WINDOW, most_hit: float = 0.5) -> DataFrame:
    """``docs`` without the hit spans; a text of which more than ``most_hit`` of the words is hit goes.

    Columns and other rows stay as they are, null texts included.
    """
    shared = [docs.sparkSession.sparkContext.broadcast(g) for g in item_groups(benchmark, item_col, item_text, MOST_WORDS)]
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automata = _built(shared, window)
        for batch in batches:
            texts, keep, out, i = byte_values(batch.column(at)), [], batch.column(at).to_pylist(), 0
            for words, hit, _ in find(texts, automata):
                sums = np.concatenate(([0], np.cumsum(hit)))
                for d, runs in enumerate(byte_runs(words, hit)):
                    n = sums[words.first[d + 1]] - sums[words.first[d]]
                    keep.append(not n or n <= most_hit * words.counts[d])
                    if runs:
                        edges = [0, *(e for r in runs for e in (r["begin"], r["end"])), len(texts[i])]
                        out[i] = b"".join(texts[i][a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)).decode()
                    i += 1
            columns = list(batch.columns)
            columns[at] = pa.array(out, batch.schema.field(at).type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema).filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def digests(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts and digest of the item ids, from ``spans``."""
    return found.select(id_col, "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "items").cast("binary"), 256).alias("items_sha256"),
                        (F.col("n_hit") > 0).alias("contaminated"), F.size("spans").cast("long").alias("n_spans"))
