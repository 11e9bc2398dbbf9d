"""Substring dedup by relative Lempel-Ziv parsing.

Segments that share a key are a reference block. The block's index holds the first
occurrence of every stretch of W words. A segment is factored greedily: at the next word
where the index has a source in an earlier document, the factor is extended as far as
both agree, and parsing goes on behind it. A window that crosses a factor's end can have
a source elsewhere; the starts in the last W - 1 words of each factor are therefore looked up too, and the
next factor begins at the first of them that has one. Factors are at least W words long;
their words are duplicates.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from . import repeats
from .textblocks import SPACE_WORDS, Words, byte_values, chunks, covered

WINDOW = 50


def kind(window: int = WINDOW) -> repeats.Kind:
    """Grams of about a quarter and a half of the window, then the window."""
    return repeats.Kind(window, (max(1, window * 12 // 50), max(1, window * 28 // 50), window), words=True, within=False)


def parse(ids: np.ndarray, at: np.ndarray, n: np.ndarray, segments: list[bytes], window: int = WINDOW) -> tuple[np.ndarray, ...]:
    """id, begin and end (words of the document) of all factors with a source in a smaller id."""
    units = repeats.Units(kind(window), segments)
    total = len(units.values)
    size = units.end - units.begin
    segment = np.repeat(np.arange(len(ids)), size)
    # index: all windows by hash, then document, then place
    ok = size >= window
    first = np.repeat(units.begin[ok], (size - window + 1)[ok])
    nth = np.arange(len(first)) - np.repeat(np.cumsum((size - window + 1)[ok]) - (size - window + 1)[ok], (size - window + 1)[ok])
    start = first + nth
    hashes = units.prefix.every(window)[start] if len(start) else np.zeros(0, np.uint64)
    order = np.lexsort((start, ids[segment[start]], hashes))
    head = np.append(True, hashes[order][1:] != hashes[order][:-1]) if len(order) else np.zeros(0, bool)
    source = np.full(total + 1, -1, np.int64)
    source[start[order]] = start[order][np.maximum.accumulate(np.where(head, np.arange(len(order)), 0))] if len(order) else 0
    has = np.flatnonzero(source[:total] >= 0)
    source[has[ids[segment[source[has]]] >= ids[segment[has]]]] = -1
    # the next start with a source, for every word
    following = np.where(source[:total] >= 0, np.arange(total), total)
    following = np.append(np.minimum.accumulate(following[::-1])[::-1], total)
    out = []
    cursor = following[units.begin]
    live = np.flatnonzero(cursor < units.end)
    cursor = cursor[live]
    while len(live):
        begin, src = cursor, source[cursor]
        low = np.full(len(live), window)
        high = np.minimum(units.end[live] - begin, units.end[segment[src]] - src)
        while (low < high).any():  # the longest common stretch, by halving
            mid = (low + high + 1) // 2
            same = units.prefix.span(begin, begin + mid) == units.prefix.span(src, src + mid)
            low, high = np.where(same, mid, low), np.where(same, high, mid - 1)
        out.append((live, begin, begin + low))
        cursor = following[begin + low - window + 1]  # starts before it lie inside the factor
        more = cursor < units.end[live]
        live, cursor = live[more], cursor[more]
    if not out:
        return (np.zeros(0, np.int64),) * 3
    which, begin, end = (np.concatenate(x) for x in zip(*out, strict=True))
    shift = at[which] - units.begin[which]
    return ids[which], begin + shift, end + shift


def duplicate_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, most: int = repeats.MOST_SEGMENTS) -> DataFrame:
    """id, text and spans (begin, end in words) that repeat windows of documents with a smaller id.

    Null texts are empty; texts shorter than a window have no spans. Rows that share an id
    are documents of their own, in the order of their texts; equal rows are one document and
    each gets its spans. Other columns play no part; an empty table gives no rows.
    """
    return repeats.spans(docs, id_col, text_col, kind(window), lambda *rows: parse(*rows, window), most)


def kept_words(text: bytes, words: Words, i: int, hit: np.ndarray) -> bytes:
    a, b = words.first[i], words.first[i + 1]
    return b" ".join(words.bytes.data[s:e].tobytes() for s, e, h in zip(words.start[a:b].tolist(), words.end[a:b].tolist(), hit[a:b].tolist(), strict=True) if not h)


def digests(found: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Word counts and the digest of the kept words, from ``duplicate_spans``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, spans = byte_values(batch.column(1)), batch.column(2).to_pylist()
            n_words, n_removed, digest, n_spans = [], [], [], []
            for lo, hi in chunks(texts):
                words = Words(texts[lo:hi], SPACE_WORDS)
                begin = [words.first[i] + s["begin"] for i in range(hi - lo) for s in spans[lo + i]]
                end = [words.first[i] + s["end"] for i in range(hi - lo) for s in spans[lo + i]]
                hit = covered(np.array(begin, int), np.array(end, int), len(words.hash))
                sums = np.concatenate(([0], np.cumsum(hit)))
                n_words += words.counts.tolist()
                n_removed += (sums[words.first[1:]] - sums[words.first[:-1]]).tolist()
                n_spans += [len(s) for s in spans[lo:hi]]
                digest += [hashlib.sha256(kept_words(texts[lo + i], words, i, hit)).hexdigest() for i in range(hi - lo)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(digest, pa.string()), pa.array(n_spans, pa.int64())], names=[id_col, "n_words", "n_removed", "kept_sha256", "n_spans"])

    kind_ = T.StructType([T.StructField(id_col, found.schema[id_col].dataType), *T._parse_datatype_string("n_words long, n_removed long, kept_sha256 string, n_spans long").fields])
    return found.select(id_col, text_col, "spans").mapInArrow(run, kind_)
