"""Vectorised hashing of words, word windows and byte windows over concatenated documents."""

from __future__ import annotations

import hashlib

import numpy as np

_RNG = np.random.Generator(np.random.PCG64(20240601))
BYTE_A = _RNG.integers(0, 2**64, 256, dtype=np.uint64)
BASE = 0x9E3779B97F4A7C15 | 1
BASE2 = 0xD1342543DE82EF95 | 1
_POWERS: dict[int, np.ndarray] = {}
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
IS_WS = np.zeros(256, bool)
IS_WS[[9, 10, 11, 12, 13, 32]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(base: int, n: int) -> np.ndarray:
    """base**i modulo 2**64 for i < n, kept for the next call."""
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        p = np.full(max(n, 1 << 16), base, np.uint64)
        p[0] = 1
        have = _POWERS[base] = np.multiply.accumulate(p)
    return have[:n]


def prefix(values: np.ndarray, base: int) -> np.ndarray:
    """Sums of values[i] * base**i over the first k values, k = 0 .. n."""
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * powers(base, len(values)), out=out[1:])
    return out


def spans(sums: np.ndarray, start: np.ndarray, end: np.ndarray, base: int) -> np.ndarray:
    """Hash of values[start:end], equal for equal contents wherever they stand."""
    inverse = pow(base, -1, 2**64)
    return mix((sums[end] - sums[start]) * powers(inverse, len(sums))[start])


def windows(sums: np.ndarray, size: int, base: int) -> np.ndarray:
    """Hash of every window of ``size`` values."""
    n = len(sums) - size
    if n <= 0:
        return np.empty(0, np.uint64)
    return mix((sums[size:] - sums[:n]) * powers(pow(base, -1, 2**64), n))


def word_spans(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every word ``[^\\x20\\x09-\\x0D]+`` and the index of each document's first word."""
    if not len(data):
        return np.empty(0, np.int64), np.empty(0, np.int64), np.zeros(len(off), np.int64)
    word = ~IS_WS[data]
    first = word.copy()
    first[1:] &= ~word[:-1]
    last = word.copy()
    last[:-1] &= ~word[1:]
    begin, end = off[:-1][off[1:] > off[:-1]], off[1:][off[1:] > off[:-1]] - 1
    first[begin] = word[begin]
    last[end] = word[end]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, off)


_LONG = 64


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of every word; other seeds give independent ones.

    Words pass 8 bytes at a time through a mixing function, so unlike sums over powers no family of words collides;
    words of over 64 bytes are hashed by BLAKE2b.
    """
    n = ends - starts
    key = mix(np.array([0x9E3779B97F4A7C15 * (seed + 1) % 2**64], np.uint64))[0]
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    view = np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))
    masks = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
    h = mix((view[starts] & masks[np.minimum(n, 8)]) ^ mix(n.astype(np.uint64) + key))
    live = np.flatnonzero((n > 8) & (n <= _LONG))
    for o in range(8, _LONG, 8):
        live = live[n[live] > o]
        if not len(live):
            break
        h[live] = mix(h[live] * np.uint64(BASE) ^ (view[starts[live] + o] & masks[np.minimum(n[live] - o, 8)]))
    for i in np.flatnonzero(n > _LONG).tolist():
        h[i] = int.from_bytes(hashlib.blake2b(data[starts[i] : ends[i]].tobytes(), digest_size=8, salt=seed.to_bytes(8, "little")).digest(), "little")
    return h


def within(off: np.ndarray, size: int, at_least: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Starts of all windows of ``size`` items that stay in one document of ``at_least`` items, and their documents."""
    n = np.diff(off)
    count = np.where(n >= max(size, at_least), n - size + 1, 0)
    doc = np.repeat(np.arange(len(n)), count)
    return np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + off[doc], doc


def classes(h: np.ndarray, h2: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """order sorting h (then h2), and where each class of equals begins in that order."""
    order = np.argsort(h) if h2 is None else np.lexsort((h2, h))
    s = h[order]
    new = np.ones(len(s), bool)
    new[1:] = s[1:] != s[:-1]
    if h2 is not None:
        t = h2[order]
        new[1:] |= t[1:] != t[:-1]
    return order, np.flatnonzero(new)


def dense_rank(ids: np.ndarray) -> np.ndarray:
    """Rank of sorted ids, equal for equal ids."""
    out = np.zeros(len(ids), np.int64)
    if len(ids):
        np.cumsum(ids[1:] != ids[:-1], out=out[1:])
    return out
