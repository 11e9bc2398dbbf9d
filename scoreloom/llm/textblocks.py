"""Whole texts as flat numpy arrays.

An Arrow column of texts becomes chunks of bounded size (one longer text makes a
chunk of its own). In a chunk every text is followed by one separator byte, so word
runs never cross texts. Words and windows carry 64-bit polynomial hashes taken from
prefix sums; equal strings have equal hashes wherever they stand.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 20
BASE = np.uint64(0x9E3779B97F4A7C15)
WORD_BASE = np.uint64(0xC2B2AE3D27D4EB4F)
_U = np.uint64

# \x20 and \x09-\x0D separate words
SPACE_WORDS = np.ones(256, bool)
SPACE_WORDS[[0x20, *range(0x09, 0x0E)]] = False
# ASCII letters, digits and everything beyond ASCII make words
ALNUM_WORDS = np.zeros(256, bool)
ALNUM_WORDS[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32

_tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(base: np.uint64, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base^i and base^-i modulo 2^64 for i < n, kept for the process."""
    have = _tables.get(int(base))
    if have is None or len(have[0]) < n:
        size = max(n, CHUNK_BYTES + 64)
        inverse = _U(pow(int(base), -1, 1 << 64))
        both = []
        for b in (base, inverse):
            p = np.full(size, b, np.uint64)
            p[0] = 1
            both.append(np.multiply.accumulate(p))
        have = _tables[int(base)] = (both[0], both[1])
    return have


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values."""
    h = (h ^ (h >> _U(32))) * _U(0xD6E8FEB86659FD93)
    h = (h ^ (h >> _U(32))) * _U(0xA0761D6478BD642F)
    return h ^ (h >> _U(29))


class Prefix:
    """Prefix sums of units; ``span(start, end)`` hashes any stretches of them."""

    def __init__(self, units: np.ndarray, base: np.uint64):
        self.up, self.down = powers(base, len(units) + 1)
        self.sums = np.zeros(len(units) + 1, np.uint64)
        np.cumsum(units.astype(np.uint64) * self.up[: len(units)], out=self.sums[1:])

    def span(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.sums[end] - self.sums[start]) * self.down[start]

    def every(self, k: int) -> np.ndarray:
        """Hashes of all stretches of k units."""
        n = max(0, len(self.sums) - k)
        return mix((self.sums[k:] - self.sums[:n]) * self.down[:n])


def byte_values(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """Texts as UTF-8; null as empty."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [b if b is not None else b"" for b in column.cast(kind).to_pylist()]


def chunks(texts: list[bytes], limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of texts of at most ``limit`` bytes together, or one text."""
    lo = total = 0
    for i, t in enumerate(texts):
        if i > lo and total + len(t) > limit:
            yield lo, i
            lo, total = i, 0
        total += len(t) + 1
    if lo < len(texts):
        yield lo, len(texts)


class Bytes:
    """Texts joined by a separator. ``begin[i]:end[i]`` is text i."""

    def __init__(self, texts: list[bytes], separator: int = 0x0A):
        self.data = np.frombuffer(bytes([separator]).join(texts) + bytes([separator]), np.uint8)
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        self.end = np.cumsum(sizes + 1) - 1
        self.begin = self.end - sizes


class Words:
    """Words of joined texts. Word w covers bytes ``start[w]:end[w]`` of text ``doc[w]``;
    text i has words ``first[i]:first[i + 1]``."""

    def __init__(self, texts: list[bytes], kind: np.ndarray, lower: bool = False):
        self.bytes = Bytes(texts)
        data = LOWER[self.bytes.data] if lower else self.bytes.data
        inside = kind[data]
        edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
        if len(data) and inside[0]:
            edge = np.concatenate(([0], edge))
        self.start, self.end = edge[::2], edge[1::2]  # the last byte is a separator
        self.first = np.concatenate((np.searchsorted(self.start, self.bytes.begin), [len(self.start)]))
        self.counts = np.diff(self.first)
        self.doc = np.repeat(np.arange(len(texts)), self.counts)
        self.hash = mix(Prefix(data + _U(1), BASE).span(self.start, self.end))

    def windows(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all stretches of k words, and whether a stretch stays in its text."""
        hashes = Prefix(self.hash, WORD_BASE).every(k)
        return hashes, self.doc[:len(hashes)] == self.doc[k - 1:] if len(hashes) else np.zeros(0, bool)


def window_minimum(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` neighbours, by doubling."""
    out, have = values, 1
    while have * 2 <= width:
        out = np.minimum(out[: len(out) - have], out[have:])
        have *= 2
    if have < width and len(out):
        rest = width - have
        out = np.minimum(out[: len(out) - rest], out[rest:])
    return out


def covered(starts: np.ndarray, ends: np.ndarray, n: int) -> np.ndarray:
    """Which of n places lie in any of the stretches."""
    steps = np.zeros(n + 1, np.int64)
    np.add.at(steps, starts, 1)
    np.add.at(steps, ends, -1)
    return np.cumsum(steps[:n]) > 0
