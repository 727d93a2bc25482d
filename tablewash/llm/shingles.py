"""Word-shingle sets of texts as sorted 64-bit hashes, by numpy."""

from __future__ import annotations

import numpy as np

_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(0, 1 << 63, 256, dtype=np.uint64) << np.uint64(1) | np.uint64(1)
_ODD = _rng.integers(0, 1 << 63, 64, dtype=np.uint64) << np.uint64(1) | np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BLANK = np.zeros(256, dtype=bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_POWERS = np.cumprod(np.full(1 << 10, _BASE), dtype=np.uint64)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit (splitmix64's finish)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def words(text: str | None) -> np.ndarray:
    """Hashes of the words (runs of bytes other than 9 to 13 and 32, A-Z lower-cased)."""
    global _POWERS
    b = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), dtype=np.uint8)
    blank = _BLANK[b]
    inside = np.flatnonzero(~blank)
    if not len(inside):
        return np.empty(0, dtype=np.uint64)
    first = np.empty(len(inside), dtype=bool)
    first[0] = True
    first[1:] = np.diff(inside) > 1
    start = np.flatnonzero(first)
    size = np.diff(np.append(start, len(inside)))
    longest = int(size.max())
    if longest > len(_POWERS):
        _POWERS = np.cumprod(np.full(longest, _BASE), dtype=np.uint64)
    place = np.arange(len(inside)) - np.repeat(start, size)
    h = np.add.reduceat(_BYTE[_LOWER[b[inside]]] * _POWERS[place], start, dtype=np.uint64)
    return mix(h + size.astype(np.uint64) * _ODD[0])


def shingles(text: str | None, n: int) -> np.ndarray:
    """Sorted distinct hashes of the n-word runs; of a shorter text its whole
    sequence; nothing without words."""
    w = words(text)
    if not len(w):
        return w
    if len(w) < n:
        h = sum((w[i:i + 1] * _ODD[1 + i] for i in range(len(w))), np.full(1, len(w), dtype=np.uint64))
    else:
        h = np.full(len(w) - n + 1, n, dtype=np.uint64)
        for i in range(n):
            h = h + w[i:len(w) - n + 1 + i] * _ODD[1 + i]
    return np.unique(mix(h))
