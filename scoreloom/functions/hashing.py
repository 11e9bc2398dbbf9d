"""``numerics.key_hash`` over arrays, for tasks that draw many numbers at once.

MD5 of texts of one block, all of one length, in 32-bit array arithmetic: about a fifth of the
time of a call per text.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np

AT_ONCE = 16_384  # texts; the arrays of a round stay in the processor's cache
SHIFTS = ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21))
SINES = [int(abs(math.sin(i + 1)) * 2**32) for i in range(64)]
START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)


def digits(values: np.ndarray, width: int) -> np.ndarray:
    """Decimal digits of ``values`` as ASCII, ``width`` to a row."""
    out = np.empty((len(values), width), np.uint8)
    rest = values.astype(np.int64)
    for i in range(width - 1, -1, -1):
        rest, out[:, i] = np.divmod(rest, 10)
    return out + 48


def _words(texts: np.ndarray) -> list:
    """The block's 16 words: arrays where texts reach, numbers where they don't."""
    n, length = texts.shape
    block = np.zeros((n, (length // 4 + 1) * 4), np.uint8)
    block[:, :length] = texts
    block[:, length] = 0x80
    reached = [np.ascontiguousarray(c) for c in block.view("<u4").T]
    return reached + [0] * (14 - len(reached)) + [length * 8, 0]


def _head(texts: np.ndarray) -> np.ndarray:
    n, words = len(texts), _words(texts)
    a, b, c, d = (np.full(n, v, np.uint32) for v in START)
    f, g = np.empty(n, np.uint32), np.empty(n, np.uint32)
    for i in range(64):
        turn = i // 16
        if turn == 0:
            np.bitwise_xor(c, d, out=f)
            np.bitwise_and(f, b, out=f)
            np.bitwise_xor(f, d, out=f)
        elif turn == 1:
            np.bitwise_xor(b, c, out=f)
            np.bitwise_and(f, d, out=f)
            np.bitwise_xor(f, c, out=f)
        elif turn == 2:
            np.bitwise_xor(b, c, out=f)
            np.bitwise_xor(f, d, out=f)
        else:
            np.invert(d, out=f)
            np.bitwise_or(f, b, out=f)
            np.bitwise_xor(f, c, out=f)
        word = words[(i, 5 * i + 1, 3 * i + 5, 7 * i)[turn] % 16]
        f += a
        if isinstance(word, np.ndarray):
            f += word
            word = 0
        f += np.uint32((SINES[i] + word) % 2**32)
        by = SHIFTS[turn][i % 4]
        np.left_shift(f, np.uint32(by), out=g)
        np.right_shift(f, np.uint32(32 - by), out=f)
        f |= g
        f += b
        a, b, c, d, f = d, f, b, c, a
    first, second = (a + np.uint32(START[0])).byteswap(), (b + np.uint32(START[1])).byteswap()
    return (first.astype(np.uint64) << np.uint64(28)) | (second >> np.uint32(4)).astype(np.uint64)


def key_hashes(texts: np.ndarray) -> np.ndarray:
    """The hash of every row of ``texts`` (bytes; at most 55 of them)."""
    if texts.shape[1] > 55:
        raise ValueError("texts of more than 55 bytes")
    return np.concatenate([_head(texts[lo:lo + AT_ONCE]) for lo in range(0, len(texts), AT_ONCE)])


def picks(seed, repeats: Sequence[int], n: int) -> np.ndarray:
    """key_hash(seed, repeat, draw) mod n for every draw below n; a row per repeat."""
    out = np.empty((len(repeats), n), np.int64)
    prefixes = [f"{seed}:{r}:".encode() for r in repeats]
    for length in sorted({len(p) for p in prefixes}):
        rows = [i for i, p in enumerate(prefixes) if len(p) == length]
        start = np.frombuffer(b"".join(prefixes[i] for i in rows), np.uint8).reshape(len(rows), 1, length)
        for width in range(1, len(str(n - 1)) + 1):
            low, high = (0 if width == 1 else 10 ** (width - 1)), min(10**width, n)
            for lo in range(low, high, AT_ONCE):
                hi = min(lo + AT_ONCE, high)
                texts = np.empty((len(rows), hi - lo, length + width), np.uint8)
                texts[:, :, :length] = start
                texts[:, :, length:] = digits(np.arange(lo, hi), width)
                out[rows, lo:hi] = (key_hashes(texts.reshape(-1, length + width)) % np.uint64(n)).astype(np.int64).reshape(len(rows), -1)
    return out
