"""Words and word shingles of many texts at once, with numpy over their UTF-8 bytes.

A word is a maximal run of bytes other than space and \\x09-\\x0D; UTF-8 never
uses those bytes inside a character. Hashes are 64 bits wide: a word is read in
blocks of 8 bytes, each of which is mixed into the hash of those before, all
words at a time; the few long ones are hashed one by one. A shingle mixes the
hashes of its words. Nothing is kept for each position of a text.
"""

from __future__ import annotations

import numpy as np
import xxhash

U = np.uint64
_rng = np.random.default_rng(20240229)
STEP = _rng.integers(0, 2**63, 8, dtype=U) * U(2) + U(1)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[9, 10, 11, 12, 13, 32]] = True
#: What of a little-endian block belongs to a word that ends after so many bytes of it.
PART = np.array([(1 << 8 * n) - 1 for n in range(9)], U)
#: Words of more blocks are hashed one by one.
MOST_BLOCKS = 16


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit moves every output bit."""
    x = (x ^ (x >> U(33))) * U(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> U(33))) * U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> U(33))


def blocks(data: np.ndarray) -> np.ndarray:
    """The 8 bytes from each position on, as a view (zeros behind the end)."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    return np.ndarray((len(data) + 1,), "<u8", padded.data, strides=(1,))


def spans(data: np.ndarray, ends: np.ndarray, space: np.ndarray = IS_SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and document number of each word; words never cross documents."""
    if not len(data):
        z = np.zeros(0, np.int64)
        return z, z, z
    gap = space[data]
    first = np.zeros(len(data) + 1, bool)
    first[ends] = True
    first = first[:-1]
    begin = ~gap
    begin[1:] &= gap[:-1] | first[1:]
    last = np.ones(len(data), bool)
    last[:-1] = gap[1:] | first[1:]
    starts, stops = np.flatnonzero(begin), np.flatnonzero(last & ~gap) + 1
    return starts, stops, np.searchsorted(ends, starts, "right") - 1


def span_hashes(data: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte ranges; equal bytes, equal hash."""
    view, left = blocks(data), stops - starts
    out = mix(left.astype(U) * STEP[5] + STEP[6])
    long = left > 8 * MOST_BLOCKS
    for i in np.flatnonzero(long):
        out[i] ^= U(xxhash.xxh3_64_intdigest(data[starts[i] : stops[i]].tobytes()))
    at = np.flatnonzero((left > 0) & ~long)
    for k in range(MOST_BLOCKS):
        at = at[left[at] > 8 * k] if k else at
        if not len(at):
            break
        part = view[starts[at] + 8 * k] & PART[np.minimum(left[at] - 8 * k, 8)]
        out[at] = mix((out[at] ^ part) * STEP[7])
    return out


def window_hashes(data: np.ndarray, size: int) -> np.ndarray:
    """Hashes of the ``size`` (a multiple of 8) bytes from each position on, where there are so many."""
    view, n = np.array(blocks(data)), len(data) - size + 1
    out = np.zeros(n, U)
    for k in range(0, size, 8):
        out = (out ^ view[k : k + n]) * STEP[k // 8 % 8]
        out ^= out >> U(29)
    return mix(out)


def word_hashes(data: np.ndarray, ends: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(hash, document number) of each word in order."""
    if lower:
        data = LOWER[data]
    starts, stops, doc = spans(data, ends)
    return span_hashes(data, starts, stops), doc


def shingles(words: np.ndarray, doc: np.ndarray, n_docs: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of k consecutive words, document by document, and the n_docs+1 bounds.

    A document of 1 to k-1 words has one shingle, its whole sequence; one
    without words has none. Repeats are kept.
    """
    counts = np.bincount(doc, minlength=n_docs)
    own = np.where(counts >= k, counts - k + 1, np.minimum(counts, 1))
    first = np.zeros(n_docs + 1, np.int64)
    np.cumsum(counts, out=first[1:])
    bounds = np.zeros(n_docs + 1, np.int64)
    np.cumsum(own, out=bounds[1:])
    at = np.arange(bounds[-1]) - np.repeat(bounds[:-1] - first[:-1], own)
    end = np.repeat(first[1:], own)
    padded = np.concatenate([words, np.zeros(k, U)])
    out = np.zeros(len(at), U)
    for j in range(k):
        out = out * STEP[0] + np.where(at + j < end, padded[at + j] * STEP[1] + STEP[2], U(0))
    return mix(out), bounds
