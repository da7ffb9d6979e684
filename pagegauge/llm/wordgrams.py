"""Words and n-grams of a batch of texts as arrays of 64-bit hashes."""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK = 1 << 20
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SAME = np.arange(256, dtype=np.uint8)
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93], dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads every bit of a 64-bit number over all of it (the finaliser of splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


@lru_cache(maxsize=2)
def _ways(base: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of ``base`` and of its inverse."""
    return powers(base, 1 << bits), powers(pow(base, -1, 1 << 64), 1 << bits)


def buffer_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts of a batch, one after the other, and where each begins (and the end)."""
    column = pc.fill_null(column.cast(pa.binary()), b"")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.zeros(0, np.uint8) if column.buffers()[2] is None else np.frombuffer(column.buffers()[2], np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


@dataclass
class Words:
    """``hash``, ``start`` and ``stop`` (bytes) of every word; words of text i are first[i]:first[i+1]."""

    data: np.ndarray
    offsets: np.ndarray
    start: np.ndarray
    stop: np.ndarray
    first: np.ndarray
    hash: np.ndarray


def words_of(column: pa.Array, lower: bool, seed: int = 0) -> Words:
    """Words are runs of other bytes than ASCII white space."""
    data, offsets = buffer_of(column)
    inside = ~_IS_SPACE[data]
    before = np.zeros(len(data), bool)
    before[1:] = inside[:-1]
    before[offsets[:-1][offsets[:-1] < len(data)]] = False
    start = np.flatnonzero(inside & ~before)
    after = np.zeros(len(data), bool)
    after[:-1] = inside[1:]
    after[offsets[1:][offsets[1:] > 0] - 1] = False
    stop = np.flatnonzero(inside & ~after) + 1
    hashes = np.zeros(len(start), np.uint64)
    table = (_LOWER if lower else _SAME).astype(np.uint64) + np.uint64(1)
    a = 0
    while a < len(start):
        b = max(a + 1, int(np.searchsorted(start, start[a] + CHUNK)))
        own = slice(start[a], stop[b - 1])
        at, end = start[a:b] - start[a], stop[a:b] - start[a]
        n = int(own.stop - own.start)
        up, down = _ways(int(_ODD[seed]), max(n, CHUNK).bit_length())
        # Sums up to each byte; what lies between two of them, moved to the first power, is a word's.
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(table.take(data[own]) * up[:n], out=sums[1:])
        hashes[a:b] = mix((sums[end] - sums[at]) * down[at] + (end - at).astype(np.uint64) * _ODD[2])
        a = b
    return Words(data, offsets, start, stop, np.searchsorted(start, offsets), hashes)


def grams(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n words from each position on (of all but the last n - 1 positions)."""
    if len(hashes) < n:
        return np.zeros(0, np.uint64)
    total = hashes[: len(hashes) - n + 1].copy()
    for j in range(1, n):
        total = total * _ODD[0] + hashes[j : len(hashes) - n + 1 + j]
    return mix(total + np.uint64(n))


def shingle_sets(words: Words, n: int) -> list[np.ndarray]:
    """Sorted distinct n-word shingles of every text; fewer words make one shingle, none make none."""
    whole = grams(words.hash, n)
    out = []
    first = words.first.tolist()
    for a, b in zip(first[:-1], first[1:], strict=True):
        if b - a >= n:
            out.append(np.unique(whole[a : b - n + 1]))
        elif b > a:
            out.append(grams(words.hash[a:b], b - a))
        else:
            out.append(np.zeros(0, np.uint64))
    return out
