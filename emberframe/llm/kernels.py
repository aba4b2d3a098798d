"""Vectorised work on the bytes of many texts at once.

All functions take the bytes of a run of texts and the offsets where each
starts, and never look across a text's end.
"""

from __future__ import annotations

import numpy as np

U = np.uint64
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

#: Added to each block of 8 bytes, one value for each of two independent hashes.
_SALT = (U(0x9E3779B97F4A7C15), U(0xD1B54A32D192ED03))
#: Bytes that are hashed at once.
SLICE = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """A fixed bijection of 64-bit values that spreads every bit."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def hash_ranges(buf: np.ndarray, start: np.ndarray, end: np.ndarray, which: int = 0) -> np.ndarray:
    """Hashes of the bytes from each start to before its end; their number counts too.

    Blocks of 8 bytes are mixed with their place and added up: unlike a
    polynomial, no repeated structure in the bytes cancels out.
    """
    out = np.zeros(len(start), U)
    if not len(start):
        return out
    size = end - start
    blocks = (size + 7) >> 3
    padded = np.concatenate([buf, np.zeros(8, np.uint8)])
    words = np.ndarray(len(buf) + 1, "<u8", padded.data, 0, (1,))
    upto = np.cumsum(blocks)
    cut, most = 0, SLICE >> 3
    while cut < len(start):  # slices of about SLICE bytes, or one range
        done = upto[cut - 1] if cut else 0
        to = max(cut + 1, int(np.searchsorted(upto, done + most, side="right")))
        some = blocks[cut:to]
        first = np.concatenate([[0], np.cumsum(some)])
        total = np.zeros(to - cut, U)
        for lo in range(0, int(first[-1]), 4 * most):  # one long range goes in pieces
            hi = min(lo + 4 * most, int(first[-1]))
            at = np.arange(lo, hi)
            owner = np.searchsorted(first, at, side="right") - 1 if lo or hi < first[-1] else np.repeat(np.arange(to - cut), some)
            place = at - first[owner]
            w = words[start[cut:to][owner] + 8 * place]
            short = size[cut:to][owner] - 8 * place
            tail = short < 8
            w[tail] &= (U(1) << (U(8) * short[tail].astype(U))) - U(1)
            x = mix(mix(w + _SALT[which]) ^ (place.astype(U) + U(1)) * U(0xC2B2AE3D27D4EB4F))
            step = np.flatnonzero(np.diff(owner, prepend=-1))
            total[owner[step]] += np.add.reduceat(x, step)
        out[cut:to] = mix(total + size[cut:to].astype(U) * U(0x2545F4914F6CDD1D))
        cut = to
    return out


def word_bounds(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every word (bytes other than the six ASCII white spaces), and how many words each text has."""
    n = len(buf)
    solid = np.zeros(n + 2, bool)
    solid[1:-1] = ~_SPACE[buf]
    first = np.zeros(n + 1, bool)
    first[offs] = True  # a text's start or end cuts words
    start = np.flatnonzero(solid[1:-1] & (~solid[:-2] | first[:-1]))
    end = np.flatnonzero(solid[1:-1] & (~solid[2:] | first[1:])) + 1
    per = np.diff(np.searchsorted(start, offs))
    return start, end, per


def word_hashes(buf: np.ndarray, offs: np.ndarray, lower: bool = True, which: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word, and how many words each text has."""
    start, end, per = word_bounds(buf, offs)
    return hash_ranges(_LOWER[buf] if lower else buf, start, end, which), per


def _shingles(words: np.ndarray, at: np.ndarray, left: np.ndarray, size: int) -> np.ndarray:
    h = np.zeros(len(at), U)
    padded = np.concatenate([words, np.zeros(size, U)])
    for k in range(size):
        there = left[at] > k
        h = mix(h * U(0x9E3779B97F4A7C15) + np.where(there, padded[at + k], U(0)) + U(k + 1))
    return h


def shingle_sets(buf: np.ndarray, offs: np.ndarray, size: int = 3, second: bool = False):
    """(text number, hash) of each text's distinct shingles of `size` words, ordered by both; with `second` also an independent hash.

    A-Z count as a-z.  A text with fewer words has one shingle of all of them, a
    text without words none.
    """
    words, per = word_hashes(buf, offs)
    if not len(words):
        return (np.zeros(0, np.int64), np.zeros(0, U)) + ((np.zeros(0, U),) if second else ())
    doc = np.repeat(np.arange(len(per)), per)
    last = np.cumsum(per)
    place = np.arange(len(words)) - (last - per)[doc]
    left = per[doc] - place  # words from here to the text's end
    at = np.flatnonzero((left >= size) | ((place == 0) & (per[doc] < size)))
    del place
    h = _shingles(words, at, left, size)
    owner = doc[at]
    order = np.lexsort((h, owner))
    h, owner = h[order], owner[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
    if not second:
        return owner[new], h[new]
    other = _shingles(word_hashes(buf, offs, which=1)[0], at[order[new]], left, size)
    return owner[new], h[new], other
