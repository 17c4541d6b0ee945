"""Word shingles of many texts at once, in numpy."""

from __future__ import annotations

import re

import numpy as np

WORDS = 5
#: Bytes of a text that are worked through at once, up to the end of a word.
PIECE = 1 << 18
_SEPARATOR = re.compile(rb"[\x09-\x0d ]")
#: Odd multipliers of the hashes, fixed values.
BASE, STEP = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93
INVERSE = pow(BASE, -1, 2**64)


def mixed(z: np.ndarray) -> np.ndarray:
    """Well spread 64-bit hashes of 64-bit values."""
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


_POWERS: dict[int, np.ndarray] = {}
with np.errstate(over="ignore"):
    _BYTES = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(STEP))


def _powers(base: int, n: int) -> np.ndarray:
    """The first powers of a base; those of a piece are kept, longer rows (of a very long word) are not."""
    if n > len(_POWERS.get(base, ())):
        factors = np.full(max(n, PIECE), base, np.uint64)
        factors[0] = 1
        powers = np.cumprod(factors)
        if n > PIECE:
            return powers
        _POWERS[base] = powers
    return _POWERS[base][:n]


def word_hashes(data: bytes) -> np.ndarray:
    """A hash of each word (run of bytes above the space) of a text, in order."""
    if len(data) <= PIECE:
        return _piece_hashes(data)
    parts, at = [], 0
    while at < len(data):
        cut = _SEPARATOR.search(data, at + PIECE)
        end = cut.start() if cut else len(data)
        parts.append(_piece_hashes(data[at:end]))
        at = end
    return np.concatenate(parts)


def _piece_hashes(data: bytes) -> np.ndarray:
    """The bytes of a word are digits of a number to an odd base, modulo 2**64; prefix sums give
    all words at once, and the inverse of the base takes a word's place out of its sum.
    """
    if not data:
        return np.zeros(0, np.uint64)
    raw = np.frombuffer(data, np.uint8)
    inside = np.concatenate([[False], (raw != 32) & ((raw < 9) | (raw > 13)), [False]])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edges[::2], edges[1::2]
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_BYTES[raw] * _powers(BASE, len(raw)), out=sums[1:])
    back = _powers(INVERSE, len(raw))
    return mixed((sums[ends] - sums[starts]) * back[starts] + (ends - starts).astype(np.uint64))


def shingle_set(data: bytes, words: int = WORDS) -> np.ndarray:
    """Sorted distinct hashes of the runs of ``words`` words; of all words, where there are fewer."""
    h = word_hashes(data)
    if not len(h):
        return h
    n = min(words, len(h))
    total = np.zeros(len(h) - n + 1, np.uint64)
    for j in range(n):
        total = total * np.uint64(BASE) + h[j : len(h) - n + 1 + j]
    return np.unique(mixed(total + np.uint64(n)))
