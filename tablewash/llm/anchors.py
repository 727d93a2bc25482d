"""Content-defined anchors and window hashes of byte strings, by numpy.

Anchors are winnowed: of every ``WIDTH`` consecutive ``GRAM``-byte grams the one
with the smallest hash is an anchor, so every string of GRAM + WIDTH - 1 bytes
holds an anchor gram, at the same place wherever the string occurs.
"""

from __future__ import annotations

import numpy as np

from tablewash.llm.shingles import mix

GRAM = 26
WIDTH = 25
LENGTH = GRAM + WIDTH - 1  # 50
CHUNK = 8  # one anchor in CHUNK ends a chunk

_rng = np.random.default_rng(20240301)
_BYTE = _rng.integers(0, 1 << 63, 256, dtype=np.uint64) << np.uint64(1) | np.uint64(1)
_P = np.uint64(0x9E3779B97F4A7C15)
_P_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_up = np.ones(1, dtype=np.uint64)
_down = np.ones(1, dtype=np.uint64)


def _powers(n: int) -> None:
    global _up, _down
    if len(_up) < n:
        size = max(n, 2 * len(_up), 1 << 16)
        _up = np.cumprod(np.append(np.uint64(1), np.full(size - 1, _P)), dtype=np.uint64)
        _down = np.cumprod(np.append(np.uint64(1), np.full(size - 1, _P_INVERSE)), dtype=np.uint64)


def prefix_hashes(b: np.ndarray) -> np.ndarray:
    """Polynomial prefix sums: those of any part follow from two of them."""
    _powers(len(b) + 1)
    out = np.zeros(len(b) + 1, dtype=np.uint64)
    np.cumsum(_BYTE[b] * _up[:len(b)], out=out[1:], dtype=np.uint64)
    return out


def part_hashes(prefix: np.ndarray, start: np.ndarray, end: np.ndarray, salt: int = 0) -> np.ndarray:
    return mix((prefix[end] - prefix[start]) * _down[start] + (end - start).astype(np.uint64) * _P + np.uint64(salt))


def gram_hashes(prefix: np.ndarray, size: int) -> np.ndarray:
    n = len(prefix) - size
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    return mix((prefix[size:] - prefix[:n]) * _down[:n])


def _sliding(h: np.ndarray, width: int, pick) -> np.ndarray:
    """Smallest or largest of each ``width`` consecutive values, by doubling."""
    done = 1
    while 2 * done <= width:
        h = pick(h[:-done], h[done:])
        done *= 2
    rest = width - done
    return pick(h[:-rest], h[rest:]) if rest else h


def anchors(h: np.ndarray) -> np.ndarray:
    """Places of the anchor grams, given the hashes of all grams."""
    if len(h) < WIDTH:
        return np.empty(0, dtype=np.int64)
    least = _sliding(h, WIDTH, np.minimum)
    pad = np.zeros(WIDTH - 1, dtype=np.uint64)
    return np.flatnonzero(_sliding(np.concatenate([pad, least, pad]), WIDTH, np.maximum) == h)
