"""Vectorised words of UTF-8 text: bounds, 64-bit hashes and shingles, for a run of documents at once."""

from __future__ import annotations

import numpy as np

_R = np.uint64(0x9E3779B97F4A7C15 | 1)
_R_INVERSE = np.uint64(pow(int(_R), -1, 1 << 64))
_powers = {"n": 0, "r": np.ones(1, np.uint64), "inverse": np.ones(1, np.uint64)}

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """r^i and r^-i modulo 2^64 for i up to n."""
    if _powers["n"] < n + 1:
        size = max(1 << 12, 1 << (n + 1).bit_length())
        for name, base in (("r", _R), ("inverse", _R_INVERSE)):
            row = np.full(size, base, np.uint64)
            row[0] = 1
            _powers[name] = np.multiply.accumulate(row)
        _powers["n"] = size
    return _powers["r"], _powers["inverse"]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit (splitmix64's finaliser)."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def prefix_hashes(data: np.ndarray) -> np.ndarray:
    """P with P[e] - P[s] = sum of (byte + 1) * r^i over s <= i < e, modulo 2^64."""
    r, _ = powers(len(data))
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * r[: len(data)], out=out[1:])
    return out


def substring_hashes(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The hash of each [start, end), the same wherever the same bytes stand."""
    _, inverse = powers(len(prefix))
    return (prefix[ends] - prefix[starts]) * inverse[starts]


def word_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words, runs of bytes other than 0x20 and 0x09-0x0D, which never cross documents;
    and for each document the number of words before it (one more entry than documents)."""
    solid = np.zeros(len(data) + 1, bool)
    solid[:-1] = ~_SPACE[data]
    begins = solid[:-1].copy()
    begins[1:] &= ~solid[:-2]
    inner = offsets[(offsets > 0) & (offsets < len(data))]
    begins[inner] = solid[inner]
    ends = solid[:-1] & ~solid[1:]
    ends[inner - 1] = solid[inner - 1]
    starts = np.flatnonzero(begins)
    return starts, np.flatnonzero(ends) + 1, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = True) -> np.ndarray:
    """A 64-bit hash of each word, by default with A-Z in lower case."""
    prefix = prefix_hashes(_LOWER[data] if lower else data)
    return mix(substring_hashes(prefix, starts, ends) + (ends - starts).astype(np.uint64))


def shingle_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash of every k neighbouring words; entry i begins at word i."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(n, k, np.uint64)
    for i in range(k):
        out = mix(out * np.uint64(0xD1342543DE82EF95) + words[i : i + n])
    return out


def document_shingles(words: np.ndarray, k: int) -> np.ndarray:
    """The sorted distinct shingles of one document: with fewer than k words the whole sequence is one, without words none."""
    if not len(words):
        return np.zeros(0, np.uint64)
    return np.unique(shingle_hashes(words, min(k, len(words))))
