"""Vectorised text kernels: words and n-grams as 64-bit hashes, many texts at once."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

SLICE = 1 << 20
_BASE = 0x9E3779B97F4A7C15
_INV = pow(_BASE, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64, on a uint64 array."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """For each code point a random odd number shared by its cases; 0 outside words."""
    low = np.zeros(0x110000, np.uint64)
    for cp in range(0x30000):
        c = chr(cp)
        if c.isalnum():
            low[cp] = ord(c.lower()[0]) + 1
    return np.where(low > 0, mix(low) | np.uint64(1), np.uint64(0))


@lru_cache(maxsize=2)
def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def codepoints(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def groups(texts: list, most: int = SLICE):
    """Runs of texts of about ``most`` characters together: (first, last + 1)."""
    i = 0
    while i < len(texts):
        j, n = i, 0
        while j < len(texts) and (j == i or n + len(texts[j] or "") <= most):
            n += len(texts[j] or "")
            j += 1
        yield i, j
        i = j


def _words(cp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and start of each word (run of letters and digits, case folded)."""
    v = _letters()[cp]
    inside = v != 0
    edge = np.diff(inside.view(np.int8), prepend=np.int8(0), append=np.int8(0))
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(start):
        return np.zeros(0, np.uint64), start
    n = SLICE * 2
    while n <= len(cp):
        n *= 2
    total = np.zeros(len(cp) + 1, np.uint64)
    np.cumsum(v * _powers(_BASE, n)[: len(cp)], out=total[1:])
    h = (total[end] - total[start]) * _powers(_INV, n)[start]
    return mix(h + (end - start).astype(np.uint64)), start


def words(texts: list) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of all texts on end, and where each text begins in them.

    None counts as an empty text.  A text longer than a slice is cut only where
    no word is cut, so a text of any length gives the same words.
    """
    parts: list[np.ndarray] = []
    counts = np.zeros(len(texts) + 1, np.int64)
    for i, j in groups(texts):
        if j == i + 1 and texts[i] and len(texts[i]) > SLICE:
            n, at, t = 0, 0, texts[i]
            while at < len(t):
                to = min(len(t), at + SLICE)
                while to < len(t) and t[to - 1].isalnum():
                    to += 1
                h, _ = _words(codepoints(t[at:to]))
                parts.append(h)
                n += len(h)
                at = to
            counts[j] = n
            continue
        own = [t or "" for t in texts[i:j]]
        h, start = _words(codepoints("\n".join(own)))
        first = np.cumsum([0] + [len(t) + 1 for t in own])
        counts[i + 1 : j + 1] = np.diff(np.searchsorted(start, first))
        parts.append(h)
    return (np.concatenate(parts) if parts else np.zeros(0, np.uint64)), np.cumsum(counts)


def shingles(h: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each run of n words within one text, and the position of its first word."""
    if len(h) < n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    g = np.zeros(len(h) - n + 1, np.uint64)
    for k in range(n):
        g = g * np.uint64(_BASE) + h[k : len(h) - n + 1 + k]
    ok = np.ones(len(g), bool)
    for b in offsets[1:-1]:
        ok[max(0, b - n + 1) : b] = False
    at = np.flatnonzero(ok)
    return mix(g[at]), at


def distinct_per_row(row: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (row, value) pairs, ordered by row."""
    order = np.lexsort((value, row))
    row, value = row[order], value[order]
    first = np.ones(len(row), bool)
    first[1:] = (row[1:] != row[:-1]) | (value[1:] != value[:-1])
    return row[first], value[first]
