"""Induced suffix sorting of one shard, vectorised: queues by first byte carry suffixes from bucket to bucket.

The sort follows the induced-sorting scheme. Positions are S or L (smaller or larger than the suffix to their
right). Suffixes at the left-most S of each run are sorted first: their substrings are named, and names are sorted
recursively in pairs, fours and so on, to the depth that is asked for. From them all L suffixes follow in one sweep
over the first bytes upwards and all S suffixes in one sweep downwards; the queue of a byte holds what earlier
buckets have put there, in order. Common prefixes of neighbours are compared eight bytes at a time.
"""

from __future__ import annotations

import numpy as np

#: Bytes that one column of a substring's key holds, and what stands after its end.
_WIDE, _END = 7, 511


def _types(t: np.ndarray) -> np.ndarray:
    """True where a suffix is S; the last one is."""
    n = len(t)
    step = np.ones(n, np.int8)
    step[:-1] = np.sign(t[1:].astype(np.int32) - t[:-1].astype(np.int32))
    known = np.where(step != 0, np.arange(n), n - 1)
    following = np.minimum.accumulate(known[::-1])[::-1]
    return step[following] > 0


def _dense(*columns: np.ndarray) -> np.ndarray:
    """Ranks of rows by the columns, equal rows equal."""
    order = np.lexsort(columns[::-1]) if len(columns) > 1 else np.argsort(columns[0], kind="stable")
    new = np.zeros(len(order), bool)
    for c in columns:
        s = c[order]
        new[1:] |= s[1:] != s[:-1]
    rank = np.empty(len(order), np.int64)
    rank[order] = np.cumsum(new)
    return rank


def _starred(t: np.ndarray, s: np.ndarray, depth: int) -> np.ndarray:
    """Left-most S positions in the order of their suffixes, to `depth` symbols."""
    at = np.flatnonzero(s[1:] & ~s[:-1]) + 1
    if len(at) < 2:
        return at
    size = np.append(at[1:] - at[:-1] + 1, len(t) - at[-1])
    wide = np.concatenate([t.astype(np.uint64), np.full(_WIDE, _END, np.uint64)])
    rank = None
    for k in range(-(-min(int(size.max()), depth + _WIDE) // _WIDE)):
        key = np.zeros(len(at), np.uint64)
        for j in range(k * _WIDE, (k + 1) * _WIDE):
            symbol = np.where(j < size, wide[np.minimum(at + j, len(wide) - 1)], np.uint64(_END))
            key = (key << np.uint64(9)) | symbol
        rank = _dense(key) if rank is None else _dense(rank, key)
    reach = 1
    while reach < depth and rank.max() < len(at) - 1:  # every substring has two symbols of its own, or is the last
        follows = np.full(len(at), -1, np.int64)
        follows[:-reach] = rank[reach:]
        rank = _dense(rank, follows)
        reach *= 2
    return at[np.argsort(rank, kind="stable")]


class _Queues:
    """Suffixes waiting at their first symbol, in the order in which they arrived."""

    def __init__(self, symbols: int):
        self.waiting: list[list[np.ndarray]] = [[] for _ in range(symbols)]

    def put(self, suffixes: np.ndarray, first: np.ndarray) -> None:
        if len(suffixes):
            order = np.argsort(first, kind="stable")
            f = first[order]
            cuts = np.flatnonzero(f[1:] != f[:-1]) + 1
            for part in np.split(suffixes[order], cuts):
                self.waiting[self.symbol(part)].append(part)

    def symbol(self, part: np.ndarray) -> int:
        return int(self.text[part[0]])

    def sweep(self, text: np.ndarray, eligible: np.ndarray, seeds: list[np.ndarray], upwards: bool) -> list[np.ndarray]:
        """All eligible suffixes by first symbol: each in turn sends its left neighbour, if eligible, to a queue.
        `seeds` stand behind the bucket's own suffixes."""
        self.text = text
        symbols = range(len(self.waiting)) if upwards else range(len(self.waiting) - 1, -1, -1)
        out: list[np.ndarray] = [np.zeros(0, np.int64)] * len(self.waiting)
        for c in symbols:
            done, wave = [], self.waiting[c]
            self.waiting[c] = []
            while wave:
                suffixes = np.concatenate(wave) if len(wave) > 1 else wave[0]
                done.append(suffixes)
                left = suffixes[suffixes > 0] - 1
                left = left[eligible[left]]
                f = text[left]
                wave = [x] if len(x := left[f == c]) else []
                other = f > c if upwards else f < c
                self.put(left[other], f[other])
            left = seeds[c][seeds[c] > 0] - 1
            left = left[eligible[left]]
            f = text[left]
            other = f > c if upwards else f < c
            self.put(left[other], f[other])
            out[c] = np.concatenate(done) if done else out[c]
        return out


def suffix_array(t: np.ndarray, depth: int) -> np.ndarray:
    """Positions of t (symbols below 511, the last one 0 and no other) in the order of their suffixes, exact to
    `depth` symbols."""
    symbols = int(t.max()) + 1
    s = _types(t)
    starred = _starred(t, s, depth)
    first = t[starred]
    seeds = [starred[first == c] for c in range(symbols)] if len(starred) < 1000 else _split(starred, first, symbols)
    large = _Queues(symbols).sweep(t, ~s, seeds, True)
    start = _Queues(symbols)
    # the last suffix has none to its right that could send it
    start.waiting[int(t[-1])].append(np.array([len(t) - 1]))
    small = start.sweep(t, s, [x[::-1] for x in large], False)
    return np.concatenate([p for c in range(symbols) for p in (large[c], small[c][::-1])])


def _split(suffixes: np.ndarray, first: np.ndarray, symbols: int) -> list[np.ndarray]:
    order = np.argsort(first, kind="stable")
    return np.split(suffixes[order], np.searchsorted(first[order], np.arange(1, symbols)))


def same_prefix(data: np.ndarray, x: np.ndarray, y: np.ndarray, length: int) -> np.ndarray:
    """Whether data[x : x + length] equals data[y : y + length], for bytes `data` that hold both."""
    words = np.lib.stride_tricks.as_strided(data.view(np.uint8), (max(len(data) - 7, 0), 8), (1, 1))
    same = np.ones(len(x), bool)
    left = np.arange(len(x))
    for k in [*range(0, length - 7, 8), length - 8]:
        eq = (words[x[left] + k].view(np.uint64) == words[y[left] + k].view(np.uint64)).ravel()
        same[left[~eq]] = False
        left = left[eq]
    return same
