"""Word and shingle hashes of flat byte arrays, without a Python step per word.

Words are runs of bytes other than blank and U+0009 to U+000D; ASCII capitals count as small letters.
A word's hash takes its bytes eight at a time and mixes every step, so that no texts but chance ones
share it; equal words have equal hashes in every task.
"""

from __future__ import annotations

import hashlib

import numpy as np

from .common import WORD_SPACES, held

WIDTH = 5
#: Bytes of a stretch from which on it is hashed alone.
LONG = 1 << 12
_P = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[list(WORD_SPACES)] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit (in place where it can)."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse modulo 2**64, for at least ``n`` places."""
    tables = held("powers", list)  # the largest table so far
    if not tables or len(tables[0][0]) <= n:
        out = []
        for base in (_P, pow(_P, -1, 1 << 64)):
            p = np.full(n + 1, base, np.uint64)
            p[0] = 1
            out.append(np.cumprod(p, dtype=np.uint64, out=p))
        tables[:] = [(out[0], out[1])]
    return tables[0]


def stretch_hashes(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each stretch of bytes, eight bytes a step; that of a long one is BLAKE2's."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.ndarray((len(data) + 1,), "<u8", padded, 0, (1,))
    out = mix(size.astype(np.uint64) * np.uint64(_P) + np.uint64(1))
    long = size > LONG
    active, at = np.flatnonzero((size > 0) & ~long), 0
    while len(active):
        left = size[active] - at
        chunk = eight[start[active] + at]
        tail = np.flatnonzero(left < 8)
        chunk[tail] &= (np.uint64(1) << (left[tail] * 8).astype(np.uint64)) - np.uint64(1)
        out[active] = mix(out[active] ^ chunk)
        active, at = active[left > 8], at + 8
    for i in np.flatnonzero(long).tolist():
        raw = data[start[i] : start[i] + size[i]].tobytes()
        out[i] = int.from_bytes(hashlib.blake2b(raw, digest_size=8).digest(), "little")
    return out


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word in order, words up to each row) of texts as flat bytes."""
    n = len(data)
    if n == 0:
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    inside = ~_IS_SPACE[data]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    start = inside.copy()
    start[1:] &= ~inside[:-1] | edge[1:-1]
    end = inside
    end[:-1] &= ~inside[1:] | edge[1:-1]
    a, b = np.flatnonzero(start), np.flatnonzero(end) + 1
    found = stretch_hashes(_FOLD[data], a, b - a)
    return found, np.searchsorted(a, offsets)


def _weights(width: int) -> np.ndarray:
    return mix(np.arange(1, width + 1, dtype=np.uint64) * np.uint64(_P)) | np.uint64(1)


def shingle_rows(found: np.ndarray, upto: np.ndarray, width: int = WIDTH) -> list[np.ndarray]:
    """The distinct shingle hashes of each row, ascending.

    A row with fewer than ``width`` words has one shingle, its whole sequence; one without words none.
    """
    w = _weights(width)
    rows: list[np.ndarray] = []
    n = len(found) - width + 1
    every = np.zeros(max(n, 0), np.uint64)
    for k in range(width):
        if n > 0:
            every += found[k : k + n] * w[k]
    every = mix(every)
    for a, b in zip(upto[:-1].tolist(), upto[1:].tolist(), strict=True):
        if b - a >= width:
            rows.append(np.unique(every[a : b - width + 1]))
        elif b > a:
            few = (found[a:b] * w[: b - a]).sum(dtype=np.uint64) + np.uint64(b - a)
            rows.append(mix(np.array([few])))
        else:
            rows.append(np.zeros(0, np.uint64))
    return rows
