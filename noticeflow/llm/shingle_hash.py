"""Vectorised word and shingle hashes of many texts at once (numpy)."""

from __future__ import annotations

import numpy as np

_rng = np.random.RandomState(20240229)
_BYTE = _rng.randint(1, 2**63 - 1, 256).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_BASE = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1


def powers(n: int, base: int = _BASE) -> np.ndarray:
    out = np.full(n, np.uint64(base & _MASK), np.uint64)
    if n:
        out[0] = 1
        np.multiply.accumulate(out, out=out)
    return out


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_POW: dict[str, np.ndarray] = {"f": powers(4096)}


def word_hashes(raw: bytes, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(hash, first byte) of every word ``[^\\x20\\x09-\\x0D]+`` of lower-cased (A-Z) bytes, or of the bytes as they are.

    A word's hash is a sum over its bytes of a random value per byte times a
    power for the place in the word, then mixed with the length.
    """
    a = np.frombuffer(raw, np.uint8)
    if a.size == 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    if lower:
        a = _LOWER[a]
    space = _SPACE[a]
    edge = np.flatnonzero(np.diff(np.concatenate(([True], space, [True])).astype(np.int8)))
    start, end = edge[0::2], edge[1::2]
    if start.size == 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    length = end - start
    if int(length.max()) > _POW["f"].size:
        _POW["f"] = powers(2 * int(length.max()))
    inside = np.flatnonzero(~space)
    place = inside - np.repeat(start, length)
    value = _BYTE[a[inside]] * _POW["f"][place]
    first = np.concatenate(([0], np.cumsum(length)[:-1]))
    return mix(np.add.reduceat(value, first) + length.astype(np.uint64)), start


def shingles(words: np.ndarray, size: int) -> np.ndarray:
    """Hash of every run of ``size`` words; one for the whole sequence if it is shorter."""
    if words.size == 0:
        return words
    n = min(size, words.size)
    out = np.full(words.size - n + 1, np.uint64(n), np.uint64)
    for k in range(n):
        out = mix(out + words[k:words.size - n + 1 + k])
    return out


def window_minima(h: np.ndarray, width: int) -> np.ndarray:
    """Place of the least hash (by its upper half, then the leftmost) of every ``width`` neighbouring hashes."""
    m = h.size
    if m < width:
        return np.zeros(0, np.int64)
    key = (h >> np.uint64(32) << np.uint64(32)) | np.arange(m, dtype=np.uint64)
    rows = -(-m // width)
    grid = np.full(rows * width, np.uint64(2**64 - 1))
    grid[:m] = key
    grid = grid.reshape(rows, width)
    head = np.minimum.accumulate(grid, 1).ravel()
    tail = np.minimum.accumulate(grid[:, ::-1], 1)[:, ::-1].ravel()
    return (np.minimum(tail[:m - width + 1], head[width - 1:m]) & np.uint64(0xFFFFFFFF)).astype(np.int64)
