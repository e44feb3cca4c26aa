"""Numpy kernels over a block's bytes: words, their hashes, shingles."""

from __future__ import annotations

import numpy as np

U = np.uint64
SPACE = np.zeros(256, bool)
SPACE[[0x20, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_BASE = 0x9E3779B97F4A7C15
_BACK = pow(_BASE, -1, 1 << 64)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads them (new array)."""
    h = h ^ (h >> U(30))
    h *= U(0xBF58476D1CE4E5B9)
    h ^= h >> U(27)
    h *= U(0x94D049BB133111EB)
    h ^= h >> U(31)
    return h


_BYTES = mix(np.arange(1, 257, dtype=U) * U(_BASE))
_powers = {1: np.ones(1, U), -1: np.ones(1, U)}


def powers(n: int, sign: int) -> np.ndarray:
    """The hash base to 0, 1, ... or 0, -1, ...; at least n of them."""
    have = _powers[sign]
    while len(have) < n:
        step = U(pow(_BASE if sign > 0 else _BACK, len(have), 1 << 64))
        have = np.concatenate([have, have * step])
    _powers[sign] = have
    return have


class Hasher:
    """64-bit hashes of any byte ranges of one array, from prefix sums."""

    def __init__(self, data: np.ndarray):
        n = len(data)
        self.sums = np.zeros(n + 1, U)
        np.cumsum(_BYTES[data] * powers(n, 1)[:n], out=self.sums[1:])
        self.back = powers(n + 1, -1)

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.back[start] + (end - start).astype(U) * U(0xD1B54A32D192ED03))


def segments(off: np.ndarray, most: int = 1 << 18):
    """Runs of whole documents of about `most` bytes: (first document, last + 1)."""
    at, n = 0, len(off) - 1
    while at < n:
        to = min(n, max(at + 1, int(np.searchsorted(off, off[at] + most, side="right")) - 1))
        yield at, to
        at = to


def words(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words [^ \\t\\n\\v\\f\\r]+, and how many each document has."""
    gap = SPACE[data]
    first = np.empty(len(data), bool)
    if len(data):
        first[0] = True
        first[1:] = gap[:-1]
        first[off[:-1][np.diff(off) > 0]] = True
    np.logical_and(first, ~gap, out=first)
    start = np.flatnonzero(first)
    last = np.empty(len(data), bool)
    if len(data):
        last[-1] = True
        last[:-1] = gap[1:]
        last[off[1:][np.diff(off) > 0] - 1] = True
    np.logical_and(last, ~gap, out=last)
    end = np.flatnonzero(last) + 1
    return start, end, np.diff(np.searchsorted(start, off))


def word_hashes(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, A-Z lower-cased, and how many each document has; worked on in cache-sized runs."""
    hashes, counts = [], []
    for a, b in segments(off):
        part, o = LOWER[data[off[a] : off[b]]], off[a : b + 1] - off[a]
        start, end, n = words(part, o)
        hashes.append(Hasher(part)(start, end))
        counts.append(n)
    return (np.concatenate(hashes) if hashes else np.zeros(0, U)), (np.concatenate(counts) if counts else np.zeros(0, np.int64))


def shingles(h: np.ndarray, counts: np.ndarray, k: int) -> list[np.ndarray]:
    """Each document's distinct k-word shingle hashes, sorted; with fewer words the whole sequence is the one shingle, without words there are none."""
    out, ends = [], np.cumsum(counts)
    rolled = np.zeros(max(0, len(h) - k + 1), U)
    for i in range(k):
        rolled = mix(rolled * U(31) + U(i + 1) + h[i : i + len(rolled)]) if len(rolled) else rolled
    for n, e in zip(counts.tolist(), ends.tolist(), strict=True):
        if n >= k:
            out.append(np.unique(rolled[e - n : e - k + 1]))
        elif n:
            v = U(n + 7777)
            for x in h[e - n : e]:
                v = mix(np.array([(int(v) * 31 + int(x)) & (1 << 64) - 1], U))[0]
            out.append(np.array([v], U))
        else:
            out.append(np.zeros(0, U))
    return out
