"""Burrows-Wheeler transforms of string collections, and merging them without sorting suffixes again.

The strings of a collection have W symbols each. A shard's transform is built
on its own; two transforms are merged by refining their interleaving: a vector
says for every place which of the two the next suffix comes from, and is
redone from the transforms until it is stable; after h rounds the places are
right for the first h symbols. The same rounds tell where neighbouring
suffixes first differ, so the common prefixes come with the merge.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Transform:
    bwt: np.ndarray  # the symbol before each sorted suffix; 0 before a whole string
    suffix: np.ndarray  # string * (W + 1) + start of each sorted suffix
    strings: int


def build(rows: np.ndarray, first: int) -> Transform:
    """The transform of ``rows`` (symbols from 1 on); ``first`` numbers its first string."""
    n, w = rows.shape
    text = np.concatenate([rows, np.zeros((n, 1), rows.dtype)], axis=1).astype(np.int64)
    rank = text.copy()
    step = 1
    while step <= w:  # order by twice as many symbols each time; a suffix that has ended ranks 0
        later = np.zeros_like(rank)
        later[:, :-step] = rank[:, step:]
        key = rank * (int(rank.max()) + 1) + later
        _, flat = np.unique(key.reshape(-1), return_inverse=True)
        rank = flat.reshape(n, w + 1)
        step *= 2
    order = np.argsort(rank.reshape(-1), kind="stable")
    before = np.zeros_like(text)
    before[:, 1:] = text[:, :-1]
    return Transform(before.reshape(-1)[order], order + first * (w + 1), n)


def merge(a: Transform, b: Transform, w: int) -> tuple[Transform, np.ndarray]:
    """The transform of both collections, and the common prefix of each suffix with the one before."""
    na, n = len(a.bwt), len(a.bwt) + len(b.bwt)
    ends = np.repeat([False, True], [a.strings, b.strings])  # the ends of strings keep their order
    source = np.zeros(n, bool)
    source[na:] = True
    both = np.concatenate([a.bwt, b.bwt])
    lcp = np.full(n, w + 1, np.int64)
    lcp[0] = 0
    block = np.zeros(n, np.int64)  # equal for suffixes that agree so far
    for depth in range(w + 1):
        place = np.empty(n, np.int64)
        place[~source] = np.arange(na)
        place[source] = np.arange(na, n)
        symbol = both[place]
        order = np.argsort(symbol, kind="stable")
        new = source[order]
        new[: len(ends)] = ends
        lead, held = symbol[order], block[order]
        differs = (lead[1:] != lead[:-1]) | (held[1:] != held[:-1])
        differs[: len(ends) - 1] = depth > 0  # an end is followed by nothing: equal ends share no symbol
        fresh = differs & (lcp[1:] > depth)
        lcp[1:][fresh] = depth
        block = np.concatenate([[0], np.cumsum(differs)])
        stable = (new == source).all()
        source = new
        if stable and not fresh.any() and depth:
            break
    place[~source] = np.arange(na)
    place[source] = np.arange(na, n)
    return Transform(both[place], np.concatenate([a.suffix, b.suffix])[place], a.strings + b.strings), lcp


def sorted_strings(words: np.ndarray, shard: int) -> tuple[np.ndarray, np.ndarray]:
    """(order, common words with the string before) of rows of words, by merging shard transforms."""
    n, w = words.shape
    _, flat = np.unique(words.reshape(-1), return_inverse=True)
    symbols = flat.reshape(n, w) + 1
    shard = max(1, min(shard, -(-n // 2)))  # two shards at least: common prefixes come from the last merge
    parts = [build(symbols[at : at + shard], at) for at in range(0, n, shard)]
    if len(parts) == 1:
        return np.zeros(1, np.int64), np.zeros(1, np.int64)
    while len(parts) > 1:
        merged = [merge(*parts[i : i + 2], w) for i in range(0, len(parts) - 1, 2)]
        lcp = merged[0][1]
        parts = [m[0] for m in merged] + parts[len(merged) * 2 :]
    whole = np.flatnonzero(parts[0].suffix % (w + 1) == 0)
    order = parts[0].suffix[whole] // (w + 1)
    # the common prefix of two whole strings is the least between them
    shared = np.minimum.reduceat(lcp[: whole[-1] + 1], np.concatenate([[0], whole[:-1] + 1]))
    shared[0] = 0
    return order, np.minimum(shared, w)


def common_bytes(words: np.ndarray, order: np.ndarray, shared: np.ndarray) -> np.ndarray:
    """Common leading bytes of neighbours, for big-endian words of 8 bytes."""
    n, w = words.shape
    at = np.minimum(shared, w - 1)
    x = words[order, at] ^ np.concatenate([np.zeros(1, np.uint64), words[order[:-1], at[1:]]])
    out = 8 * at
    for bits in range(56, -1, -8):
        out = out + (x < np.uint64(1) << np.uint64(bits))
    out[0] = 0
    return out
