"""Vectorised hashes of words and of windows of words."""

from __future__ import annotations

import numpy as np

_BASE = 0x9E3779B97F4A7C15
_BACK = pow(_BASE, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def word_hashes(raw: bytes) -> np.ndarray:
    """A 64-bit hash of each word of ``raw``, where single spaces separate the words."""
    data = np.frombuffer(raw, np.uint8)
    spaces = np.flatnonzero(data == 32)
    start, end = np.r_[0, spaces + 1], np.r_[spaces, len(data)]
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _powers(_BASE, len(data)), dtype=np.uint64)])
    return mix((total[end] - total[start]) * _powers(_BACK, len(data))[start] ^ (end - start).astype(np.uint64))


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def window_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """A hash of every window of ``size`` words, in order; equal windows have equal hashes."""
    n = len(words) - size + 1
    if n < 1:
        return np.empty(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for k in range(size):
        out = mix(out + words[k : k + n] + np.uint64(k + 1))
    return out
