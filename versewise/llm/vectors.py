"""Vectorised hashing of text: words and character runs as 64-bit numbers."""

from __future__ import annotations

import numpy as np

BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
_POWERS = {int(BASE): np.ones(1, np.uint64), int(INVERSE): np.ones(1, np.uint64)}


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base^0 .. base^(n-1) modulo 2^64; grown by doubling and kept."""
    have = _POWERS[int(base)]
    while len(have) < n:
        step = np.uint64(int(have[-1]) * int(base) & (1 << 64) - 1)
        have = np.concatenate([have, have * step])
    _POWERS[int(base)] = have
    return have[:n]


def mixed(h: np.ndarray) -> np.ndarray:
    """Spread of 64-bit numbers, so that any of their bits serve as a hash."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def prefix_sums(codes: np.ndarray) -> np.ndarray:
    """Sums of code x BASE^position before each position, modulo 2^64."""
    out = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * powers(BASE, len(codes)), out=out[1:])
    return out


def span_hash(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of each stretch, the same wherever it stands."""
    return mixed((sums[ends] - sums[starts]) * powers(INVERSE, len(sums))[starts] + (ends - starts).astype(np.uint64))


def word_spans(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words in UTF-8 bytes."""
    edge = np.diff(np.concatenate([[True], SPACE[raw], [True]]).astype(np.int8))
    return np.nonzero(edge == -1)[0], np.nonzero(edge == 1)[0]


def words_of(text: str | None) -> np.ndarray:
    """64-bit hash of each word of the lower-cased text."""
    raw = np.frombuffer((text or "").lower().encode(), np.uint8)
    starts, ends = word_spans(raw)
    return span_hash(prefix_sums(raw), starts, ends)


def windows(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of k hashes (of all of them if they are fewer)."""
    n = len(h)
    if n == 0:
        return h
    k = min(k, n)
    out = np.zeros(n - k + 1, np.uint64)
    for j in range(k):
        out = out * BASE + h[j:n - k + 1 + j]
    return mixed(out + np.uint64(k))


def slots(h: np.ndarray, bits: int) -> np.ndarray:
    return (h >> np.uint64(64 - bits)).astype(np.int64)
