"""Sets of word shingles as 64-bit numbers, from the bytes of texts."""

from __future__ import annotations

import numpy as np

#: Bytes that separate words.
_SEPARATES = np.zeros(256, bool)
_SEPARATES[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_BASE = np.uint64(0x9E3779B97F4A7C15)  # odd, so it has an inverse modulo 2**64
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def mix(x: np.ndarray) -> np.ndarray:
    """A one-to-one scramble of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * _BASE)[_LOWER]
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, at least n of each."""
    if len(_POWERS.get("up", ())) < n:
        size = max(n, 1 << 20)
        for name, base in (("up", _BASE), ("down", _INVERSE)):
            steps = np.full(size, base)
            steps[0] = 1
            _POWERS[name] = np.multiply.accumulate(steps)
    return _POWERS["up"], _POWERS["down"]


def shingle_sets(texts: list[str], width: int) -> list[np.ndarray]:
    """Of each text the sorted distinct shingles of ``width`` words.

    A-Z count as a-z. A text with fewer words is one shingle, its whole
    sequence; one without words has the empty set. A shingle is a 64-bit hash of
    the words' hashes, and a word's is a polynomial over scrambled bytes.
    """
    data = np.frombuffer("\n".join([*texts, ""]).encode(), np.uint8)
    lengths = np.fromiter((len(t.encode()) if not t.isascii() else len(t) for t in texts), np.int64, len(texts))
    ends = np.cumsum(lengths + 1) - 1
    gap = _SEPARATES[data]
    word = ~gap
    starts = np.flatnonzero(word & np.concatenate([[True], gap[:-1]]))
    stops = np.flatnonzero(gap & np.concatenate([[False], word[:-1]]))
    up, down = _powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * up[: len(data)], out=sums[1:])
    words = (sums[stops] - sums[starts]) * down[starts]
    words = mix(words + (stops - starts).astype(np.uint64) * _M1)
    first = np.searchsorted(starts, np.concatenate([[0], ends[:-1] + 1]))
    last = np.searchsorted(starts, ends)
    joined = np.zeros(max(len(words) - width + 1, 0), np.uint64)
    for k in range(width):
        joined = mix(joined * _BASE + words[k : k + len(joined)]) if len(joined) else joined
    out = []
    for a, b in zip(first.tolist(), last.tolist()):
        if b - a >= width:
            one = np.sort(joined[a : b - width + 1])
            out.append(one[np.concatenate([[True], one[1:] != one[:-1]])])
        elif b > a:
            one = np.full(1, b - a, np.uint64)  # apart from full shingles
            for k in range(a, b):
                one = mix(one * _BASE + words[k : k + 1])
            out.append(mix(one + _M2))
        else:
            out.append(np.zeros(0, np.uint64))
    return out
