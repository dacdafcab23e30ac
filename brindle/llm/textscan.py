"""Vectorised scans of UTF-8 text: word bounds, word hashes, rolling hashes and their minima.

All hashes are unsigned 64-bit and depend on the content alone, so every task, run and
table gives the same ones.
"""

from __future__ import annotations

import numpy as np

#: Bytes of text that are hashed at a time; temporary arrays take about 60 times as much.
CHUNK = 1 << 18
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32
_TABLES: dict[int, np.ndarray] = {}


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    h = (h ^ (h >> np.uint64(30))) * _MIX[0]
    h = (h ^ (h >> np.uint64(27))) * _MIX[1]
    return h ^ (h >> np.uint64(31))


def _powers(base: int, n: int) -> np.ndarray:
    got = _TABLES.get(base)
    if got is None or len(got) < n:
        got = np.full(max(n, CHUNK + 1), base, np.uint64)
        got[0] = 1
        _TABLES[base] = got = np.multiply.accumulate(got)
    return got[:n]


def word_bounds(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each word: a maximal run of bytes that are not ASCII white space."""
    edge = np.flatnonzero(np.diff(SPACE[data].view(np.int8), prepend=np.int8(1), append=np.int8(1)))
    return edge[::2], edge[1::2]


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of each word's bytes: its polynomial, moved to the place 0, then mixed with its length."""
    out = np.empty(len(starts), np.uint64)
    at = 0
    while at < len(starts):
        low = int(starts[at])
        to = max(at + 1, int(np.searchsorted(ends, low + CHUNK, "right")))
        part = data[low : int(ends[to - 1])]
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum((part.astype(np.uint64) + np.uint64(1)) * _powers(_BASE, len(part)), out=sums[1:])
        s, e = starts[at:to] - low, ends[at:to] - low
        out[at:to] = mixed((sums[e] - sums[s]) * _powers(_INVERSE, len(part))[s] + (e - s).astype(np.uint64))
        at = to
    return out


def rolling(symbols: np.ndarray, k: int) -> np.ndarray:
    """A hash of each k consecutive symbols, by joining hashes of doubled lengths."""
    n = len(symbols) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h, size, done, out = symbols.astype(np.uint64) + np.uint64(1), 1, 0, None
    while True:
        if k & size:
            power = np.uint64(pow(_BASE, size, 1 << 64))
            out = h[:n].copy() if out is None else out * power + h[done : done + n]
            done += size
        if done == k:
            return mixed(out)
        h = h[: len(h) - size] * np.uint64(pow(_BASE, size, 1 << 64)) + h[size:]
        size *= 2


def sliding_min(h: np.ndarray, w: int) -> np.ndarray:
    """The least of each w consecutive values."""
    n = len(h) - w + 1
    if n <= 0:
        return h[:0]
    size = 1
    while size * 2 <= w:
        h = np.minimum(h[:-size], h[size:])
        size *= 2
    return np.minimum(h[:n], h[w - size : w - size + n])


def anchors(symbols: np.ndarray, window: int, k: int) -> np.ndarray:
    """For each window of symbols the least hash of its k-grams. Equal windows have equal ones."""
    parts, at, n = [], 0, len(symbols)
    while at + window <= n:
        to = min(n, at + CHUNK + window - 1)
        parts.append(sliding_min(rolling(symbols[at:to], k), window - k + 1))
        at = to - window + 1
    return np.concatenate(parts) if parts else np.zeros(0, np.uint64)


def planes(values: np.ndarray) -> bytes:
    """The values' bytes by significance; sorted values then compress well."""
    return np.ascontiguousarray(values.view(np.uint8).reshape(len(values), -1).T).tobytes()


def from_planes(data: bytes, dtype) -> np.ndarray:
    width = np.dtype(dtype).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(width, -1).T).reshape(-1).view(dtype)
