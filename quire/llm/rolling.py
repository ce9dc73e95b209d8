"""Rolling hashes of byte strings with numpy: prefix sums of a polynomial mod 2**64.

Strings compared by these hashes are shorter than 1024 bytes, below the length at
which arithmetic mod 2**64 has systematic collisions.
"""

from __future__ import annotations

import numpy as np

_BASE = 0x9E3779B97F4A7C15
_MIX = np.uint64(0xD6E8FEB86659FD93)
_powers = (np.ones(1, np.uint64), np.ones(1, np.uint64))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i for i < n, kept for later calls."""
    global _powers
    if len(_powers[0]) < n:
        up, down = (np.full(2 * n, x, np.uint64) for x in (_BASE, pow(_BASE, -1, 1 << 64)))
        up[0] = down[0] = 1
        _powers = np.cumprod(up), np.cumprod(down)
    return _powers[0][:n], _powers[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    x = x * _MIX
    x ^= x >> np.uint64(32)
    x *= _MIX
    x ^= x >> np.uint64(29)
    return x


def prefix_sums(data: np.ndarray) -> np.ndarray:
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(len(data))[0], out=out[1:])
    return out


def spans_hash(sums: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Unmixed hashes of data[start:stop]."""
    return (sums[stop] - sums[start]) * powers(len(sums))[1][start]


def sliding(x: np.ndarray, w: int, f: np.ufunc, pad) -> np.ndarray:
    """f over each window of w elements."""
    n = len(x) - w + 1
    rows = np.full(-(-len(x) // w) * w, pad, x.dtype)
    rows[:len(x)] = x
    rows = rows.reshape(-1, w)
    before = f.accumulate(rows, 1).ravel()
    after = f.accumulate(rows[:, ::-1], 1)[:, ::-1].ravel()
    return f(after[:n], before[w - 1:w - 1 + n])


def anchors(data: np.ndarray, gram: int, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positions whose gram has the least hash in some window of ``window`` grams, these hashes, and the prefix sums.
    Ties all count, so equal stretches of ``gram + window - 1`` bytes have equal anchors."""
    sums = prefix_sums(data)
    n = len(data) - gram + 1
    if n < window:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), sums
    at = np.arange(n)
    h = mix(spans_hash(sums, at, at + gram))
    least = sliding(h, window, np.minimum, np.iinfo(np.uint64).max)
    edge = np.zeros(window - 1, np.uint64)
    largest = sliding(np.concatenate((edge, least, edge)), window, np.maximum, 0)
    pos = np.flatnonzero(largest == h)
    return pos, h[pos], sums
