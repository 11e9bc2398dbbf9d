"""Suffix-array dedup by column-wise construction over a collection of segments.

All segments of a collection grow from the right, one symbol each a round. Two files hold
the collection's Burrows-Wheeler transform and the common prefixes of neighbouring
suffixes, a third the suffixes themselves; a round reads them front to back once to find
where each new suffix goes, and once more to copy them with the new suffixes put in. No
suffix is ever compared with another: its place is the number of smaller first symbols
plus the rank of its symbol in the transform before the suffix it grew from, and its
common prefix with a neighbour is one more than the least common prefix between the two
places they grew from.

When all rounds are over, suffixes that share W bytes are neighbours. The earliest start
of each such class stays; every other start makes W bytes of its document a duplicate.
"""

from __future__ import annotations

import hashlib
import os
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from . import repeats
from .textblocks import byte_values

WINDOW = 100
READ = 1 << 18  # entries read at once
NONE = 255  # no symbol to the left; UTF-8 has no such byte
FILES = (("bwt", np.uint8), ("lcp", np.uint8), ("who", np.int32))
LONGEST = 254  # bytes of a segment


def kind(window: int = WINDOW) -> repeats.Kind:
    return repeats.Kind(window, (max(1, window * 24 // 100), max(1, window * 80 // 100), window), words=False, within=True, sieve=True)


class Column:
    """The three files of one round, read and written front to back. Two columns take turns;
    every round writes more than the one before last, so nothing old is left behind."""

    def __init__(self, folder: str, name: str):
        self.files = [open(os.path.join(folder, f"{name}-{kind_}"), "w+b", buffering=0) for kind_, _ in FILES]

    def rewind(self) -> Column:
        for f in self.files:
            f.seek(0)
        return self

    def read(self, n: int, which: int = 3) -> list[np.ndarray]:
        return [np.fromfile(f, kind_, n) for f, (_, kind_) in zip(self.files[:which], FILES, strict=False)]

    def write(self, arrays: list[np.ndarray]) -> None:
        for f, a in zip(self.files, arrays, strict=True):
            a.tofile(f)

    def close(self) -> None:
        for f in self.files:
            f.close()


def _places(column: Column, base: np.ndarray, position: np.ndarray) -> tuple[np.ndarray, ...]:
    """One pass over transform and common prefixes. For suffixes at sorted ``position``: the
    place of each one grown by its symbol and its common prefix with the entry before; then
    place and common prefix of old entries that get a new neighbour before them."""
    before, seen_new, least = np.zeros(256, np.int64), np.zeros(256, bool), np.full(256, NONE, np.int64)
    new_at, new_lcp, old_at, old_lcp = [], [], [], []
    start = done = 0
    while True:
        x, lcp = column.read(READ, 2)
        n = len(x)
        if not n:
            break
        upto = np.searchsorted(position, start + n)
        fresh = np.zeros(n, bool)
        fresh[position[done:upto] - start] = True
        order = np.argsort(x, kind="stable")
        counts = np.bincount(x, minlength=256)
        head = np.cumsum(counts) - counts
        sorted_fresh = fresh[order]
        after = np.append(False, sorted_fresh[:-1])  # follows a new one of its symbol
        present = np.flatnonzero(counts)
        after[head[present]] = seen_new[present]
        pick = np.flatnonzero((sorted_fresh | after)[: n - counts[NONE]])
        q = order[pick]
        c = x[q]
        first = pick == head[c]
        low = np.where(first, 0, order[pick - 1] + 1)
        tail = np.append(lcp, np.uint8(NONE))
        inner = np.minimum.reduceat(tail, np.stack((low, q + 1), axis=1).ravel())[::2].astype(np.int64) if len(q) else np.zeros(0, np.int64)
        value = np.where(first, np.minimum(inner, least[c]), inner) + 1
        value[first & (before[c] == 0)] = 0  # the first suffix with this symbol
        place = base[c] + before[c] + pick - head[c]
        mine = fresh[q]
        back = np.argsort(q[mine])  # in the order of ``position``
        new_at.append(place[mine][back])
        new_lcp.append(value[mine][back])
        old_at.append(place[~mine])
        old_lcp.append(value[~mine])
        rest = np.append(np.minimum.accumulate(lcp[::-1])[::-1], np.uint8(NONE)).astype(np.int64)
        least = np.minimum(least, rest[0])
        last = order[head[present] + counts[present] - 1]
        least[present] = rest[last + 1]
        seen_new[present] = fresh[last]
        before += counts
        start, done = start + n, upto
    return tuple(np.concatenate(x) for x in (new_at, new_lcp, old_at, old_lcp))


def _grown(old: Column, new: Column, total: int, at: np.ndarray, entries: list[np.ndarray], old_at: np.ndarray, old_lcp: np.ndarray) -> None:
    """Copy the files with new entries at sorted places ``at``; common prefixes at ``old_at`` change."""
    for start in range(0, total, READ):
        stop = min(total, start + READ)
        a, b = np.searchsorted(at, (start, stop))
        mask = np.ones(stop - start, bool)
        mask[at[a:b] - start] = False
        out = []
        for had, fresh in zip(old.read(stop - start - (b - a)), entries, strict=True):
            merged = np.empty(stop - start, had.dtype)
            merged[mask] = had
            merged[~mask] = fresh[a:b]
            out.append(merged)
        c, d = np.searchsorted(old_at, (start, stop))
        out[1][old_at[c:d] - start] = old_lcp[c:d]
        new.write(out)


def build(segments: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Common prefix with the entry before, segment and offset of every suffix in order
    (the empty ones first). Equal suffixes stand in the order of segments."""
    n = len(segments)
    data = np.frombuffer(b"".join(segments), np.uint8)
    size = np.fromiter(map(len, segments), np.int64, n)
    if n and (size.max() > LONGEST or n >= 1 << 23):
        raise ValueError("segments are too long or too many for one collection")
    end = np.cumsum(size)
    with tempfile.TemporaryDirectory() as folder:
        old, new = Column(folder, "even"), Column(folder, "odd")
        symbol = np.where(size > 0, data[np.maximum(end - 1, 0)] if len(data) else 0, NONE).astype(np.uint8)
        old.write([symbol, np.zeros(n, np.uint8), (np.arange(n) * 256 + size).astype(np.int32)])
        totals = np.bincount(symbol, minlength=256)
        who, position, entries = np.arange(n), np.arange(n), n
        for t in range(1, int(size.max(initial=0)) + 1):
            live = size[who] >= t  # ``position`` is sorted, ``who`` goes with it
            who, position = who[live], position[live]
            base = n + np.cumsum(totals) - totals
            at, lcp, old_at, old_lcp = _places(old.rewind(), base, position)
            order = np.argsort(at, kind="stable")
            who, position, lcp = who[order], at[order], lcp[order]
            symbol = np.where(size[who] > t, data[np.maximum(end[who] - t - 1, 0)], NONE).astype(np.uint8)
            entries += len(who)
            order = np.argsort(old_at, kind="stable")
            _grown(old.rewind(), new.rewind(), entries, position, [symbol, lcp.astype(np.uint8), (who * 256 + size[who] - t).astype(np.int32)], old_at[order], old_lcp[order])
            totals = totals + np.bincount(symbol, minlength=256)
            old, new = new, old
        _, lcp, both = old.rewind().read(-1)
        old.close()
        new.close()
    return lcp, both >> 8, both & 255


def repeated(ids: np.ndarray, at: np.ndarray, n: np.ndarray, segments: list[bytes], window: int = WINDOW) -> tuple[np.ndarray, ...]:
    """id, begin and end of stretches covered by windows that start earlier as well."""
    lcp, who, offset = build(segments)
    deep = lcp >= window
    start = np.flatnonzero(~deep)
    group = np.cumsum(~deep) - 1
    _, rank = np.unique(ids, return_inverse=True)
    low = int(at.min()) if len(at) else 0
    place = (rank[who].astype(np.int64) << 40) + (at[who] - low + offset)
    least = np.minimum.reduceat(place, start) if len(start) else place
    again = place > least[group] if len(start) else np.zeros(0, bool)
    begin = place[again]
    if not len(begin):
        return (np.zeros(0, np.int64),) * 3
    begin = np.unique(begin)
    new = np.append(True, begin[1:] != begin[:-1] + 1)
    first, last = begin[new], begin[np.append(new[1:], True)]
    names = np.unique(ids)
    mask = (1 << 40) - 1
    return names[first >> 40], (first & mask) + low, (last & mask) + low + window


def duplicate_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, most: int = repeats.MOST_SEGMENTS) -> DataFrame:
    """id, text and spans (begin, end in UTF-8 bytes) that repeat windows which start earlier:
    in a smaller id, or before in the same text.

    Null texts are empty; texts shorter than a window have no spans. Rows that share an id
    are documents of their own, in the order of their texts; equal rows are one document and
    each gets its spans. Other columns play no part; an empty table gives no rows.
    """
    if window + repeats.RUN - 1 > LONGEST:
        raise ValueError(f"windows have {LONGEST + 1 - repeats.RUN} bytes at most")
    return repeats.spans(docs, id_col, text_col, kind(window), lambda *rows: repeated(*rows, window), most)


def digests(found: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Byte counts and the digest of the kept bytes, from ``duplicate_spans``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text, spans in zip(byte_values(batch.column(1)), batch.column(2).to_pylist(), strict=True):
                edges = [0, *(e for s in spans for e in (s["begin"], s["end"])), len(text)]
                kept = b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
                rows.append((len(text), len(text) - len(kept), len(spans), hashlib.sha256(kept).hexdigest()))
            size, removed, n, digest = zip(*rows, strict=True) if rows else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(size, pa.int64()), pa.array(removed, pa.int64()), pa.array(n, pa.int64()), pa.array(digest, pa.string())], names=[id_col, "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    kind_ = T.StructType([T.StructField(id_col, found.schema[id_col].dataType), *T._parse_datatype_string("n_bytes long, n_removed long, n_spans long, kept_sha256 string").fields])
    return found.select(id_col, text_col, "spans").mapInArrow(run, kind_)
