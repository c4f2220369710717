"""Hashes of words and word shingles over flat UTF-8 buffers, without a step a word in Python.

Words are runs of anything but space and 0x09-0x0D; A-Z count as a-z. A word's hash comes from
differences of prefix sums of a polynomial modulo 2**64, mixed by multiplying and shifting; a
shingle's hash from a weighted sum of its words' hashes, mixed again. Buffers are hashed in blocks
of whole words, so temporary arrays stay small however long a text is.
"""

from __future__ import annotations

import numpy as np

_BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2**64
_INVERSE = pow(_BASE, -1, 1 << 64)

#: Bytes that are hashed at a time; only a longer word makes a longer block.
BLOCK = 1 << 20

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_powers: list[np.ndarray] = [np.empty(0, np.uint64), np.empty(0, np.uint64)]


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash (shift, multiply, shift)."""
    h = h ^ (h >> np.uint64(30))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def _power(n: int) -> list[np.ndarray]:
    """Powers of the base and of its inverse, up to n of them; what is over two blocks' worth isn't kept."""
    if len(_powers[0]) >= n:
        return _powers
    found = []
    for base in (_BASE, _INVERSE):
        steps = np.full(max(n, BLOCK + 1), base, np.uint64)
        steps[0] = 1
        found.append(np.multiply.accumulate(steps))
    if n <= 2 * BLOCK:
        _powers[:] = found
    return found


def _block_hashes(data: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and first byte of each word; a word also ends before each of the places ``edges``."""
    n = len(data)
    blank = _SPACE[data]
    edge = np.empty(n + 1, bool)  # a word may begin here: after white space, or at the start of a text
    edge[0] = True
    edge[1:] = blank
    edge[edges] = True
    starts = np.flatnonzero(edge[:n] & ~blank)
    stop = np.empty(n, bool)  # a word ends after this byte
    stop[:-1] = blank[1:]
    stop[-1:] = True
    stop[edges[edges > 0] - 1] = True
    stops = np.flatnonzero(stop & ~blank) + 1
    power, inverse = _power(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((_LOWER[data].astype(np.uint64) + np.uint64(1)) * power[:n], out=sums[1:])
    return mix((sums[stops] - sums[starts]) * inverse[starts] + (stops - starts).astype(np.uint64)), starts


def _cut(data: np.ndarray, offsets: np.ndarray, at: int) -> int:
    """Where the block from ``at`` ends: after white space or a text, or else after the longer word that it begins with."""
    to = at + BLOCK
    if to >= len(data):
        return len(data)
    text = int(offsets[np.searchsorted(offsets, to, side="right") - 1])
    blank = np.flatnonzero(_SPACE[data[at:to]])
    if (cut := max(text, at + int(blank[-1]) + 1 if len(blank) else 0)) > at:
        return cut
    end = int(offsets[np.searchsorted(offsets, at, side="right")])  # of the text that goes on
    while to < end:
        blank = np.flatnonzero(_SPACE[data[to : to + BLOCK]])
        if len(blank):
            return min(end, to + int(blank[0]) + 1)
        to += BLOCK
    return end


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For texts at ``offsets`` of the bytes ``data``: hash of each word, and words before each text and in all."""
    hashes, starts, at = [np.empty(0, np.uint64)], [np.empty(0, np.int64)], 0
    while at < len(data):
        to = _cut(data, offsets, at)
        found, first = _block_hashes(data[at:to], offsets[np.searchsorted(offsets, at) : np.searchsorted(offsets, to, side="right")] - at)
        hashes.append(found)
        starts.append(first + at)
        at = to
    return np.concatenate(hashes), np.searchsorted(np.concatenate(starts), offsets)


def shingle_hashes(words: np.ndarray, before: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the shingles of ``width`` words of each text, and shingles before each text.

    A text of fewer words is one shingle of all of them; one without words has none. Shingle k of a
    text of enough words starts at its word k.
    """
    counts = np.diff(before)
    many = np.where(counts >= width, counts - width + 1, np.minimum(counts, 1))
    ends = np.concatenate([[0], np.cumsum(many)])
    padded = np.concatenate([words, np.zeros(width, np.uint64)])
    sums = np.zeros(len(words), np.uint64)
    weights = mix(np.arange(1, width + 1, dtype=np.uint64)) | np.uint64(1)
    for k in range(width):
        sums += padded[k : k + len(words)] * weights[k]
    at = np.repeat(before[:-1], many) + np.arange(ends[-1]) - np.repeat(ends[:-1], many)
    out = sums[at]
    for i in np.flatnonzero((counts > 0) & (counts < width)):
        own = words[before[i] : before[i + 1]]
        out[ends[i]] = (own * weights[: len(own)]).sum(dtype=np.uint64) + np.uint64(len(own))
    return mix(out), ends


def flat(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """One buffer of all the texts, and their offsets in it."""
    offsets = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) for t in texts], out=offsets[1:])
    return np.frombuffer(b"".join(texts), np.uint8), offsets
