"""Suffix arrays of shards by induced sorting, and their permuted common prefixes, on numpy arrays.

Suffixes are classified as smaller (S) or larger (L) than the next one; leftmost-S substrings are
sorted by inducing, named, and the string of names is sorted in turn; then all suffixes are
induced from its order. Inducing goes bucket by bucket, and within a bucket by all entries that are
known at once, so that the work is linear and each step is an array operation.
"""

from __future__ import annotations

import numpy as np


def smaller(s: np.ndarray) -> np.ndarray:
    """Whether each suffix is smaller than the next one. s ends with a unique smallest symbol."""
    n = len(s)
    rising = np.zeros(n, bool)
    rising[:-1] = s[:-1] < s[1:]
    rising[-1] = True
    differs = np.ones(n, bool)
    differs[:-1] = s[:-1] != s[1:]
    nxt = np.where(differs, np.arange(n, dtype=np.int32), np.int32(n - 1))
    nxt = np.minimum.accumulate(nxt[::-1])[::-1]  # equal symbols do as the end of their run does
    return rising[nxt]


def spread(sa: np.ndarray, at: np.ndarray, s: np.ndarray, found: np.ndarray, step: int) -> None:
    """Puts found, in order, at the next free places of their symbols' buckets; step 1 goes up, -1 down."""
    symbols = s[found]
    order = np.argsort(symbols, kind="stable")
    found, symbols = found[order], symbols[order]
    new = np.flatnonzero(np.concatenate([[True], symbols[1:] != symbols[:-1]]))
    size = np.diff(np.concatenate([new, [len(symbols)]]))
    within = np.arange(len(symbols)) - np.repeat(new, size)
    sa[at[symbols] + step * within] = found
    at[symbols[new]] += step * size


def induce(s: np.ndarray, is_s: np.ndarray, seeds: np.ndarray, heads: np.ndarray, tails: np.ndarray) -> np.ndarray:
    """All suffixes in order, from leftmost-S ones in order. heads and tails: the bounds of each symbol's bucket."""
    n, used = len(s), np.flatnonzero(tails > heads)
    sa = np.full(n, -1, np.int32)
    seed_symbols = s[seeds]
    bounds = np.searchsorted(seed_symbols, np.arange(len(heads) + 1))
    up = heads.copy()
    for c in used.tolist():  # larger suffixes, from the front
        lo = heads[c]
        while lo < up[c]:
            hi = up[c]
            before = sa[lo:hi] - 1
            lo = hi
            before = before[before >= 0]
            before = before[~is_s[before]]
            if len(before):
                spread(sa, up, s, before, 1)
        own = seeds[bounds[c] : bounds[c + 1]] - 1
        own = own[own >= 0]  # what stands before a leftmost-S suffix is larger
        if len(own):
            spread(sa, up, s, own, 1)
    down = tails - 1
    for c in used[::-1].tolist():  # smaller suffixes, from the back
        hi = tails[c]
        while hi - 1 > down[c]:
            lo = down[c] + 1
            before = sa[lo:hi][::-1] - 1
            hi = lo
            before = before[before >= 0]
            before = before[is_s[before]]
            if len(before):
                spread(sa, down, s, before, -1)
        own = sa[heads[c] : up[c]][::-1] - 1
        own = own[own >= 0]
        own = own[is_s[own]]
        if len(own):
            spread(sa, down, s, own, -1)
    sa[heads[int(s[-1])]] = n - 1
    return sa


def named(s: np.ndarray, lms: np.ndarray, order: np.ndarray) -> np.ndarray:
    """A number for each leftmost-S substring, in text order; equal ones share it. order: them sorted."""
    index = np.empty(len(s), np.int32)
    index[lms] = np.arange(len(lms))
    rank = index[order]
    length = np.append(np.diff(lms) + 1, 1)
    a, b = order[:-1], order[1:]
    la, lb = length[rank[:-1]], length[rank[1:]]
    new = la != lb
    live = np.flatnonzero(~new)
    k = 0
    while len(live):
        off = s[a[live] + k] != s[b[live] + k]
        new[live[off]] = True
        live = live[~off]
        k += 1
        live = live[la[live] > k]
    names = np.empty(len(lms), np.int64)
    names[rank] = np.concatenate([[0], np.cumsum(new)])
    return names


def by_doubling(names: np.ndarray) -> np.ndarray:
    """Order of the suffixes of a string over many symbols, by ranks of doubled length; only ties are sorted again."""
    n, reach = len(names), 1
    order = np.argsort(names, kind="stable")
    rank = names
    while True:
        sorted_rank = rank[order]
        same = np.concatenate([[False], sorted_rank[1:] == sorted_rank[:-1]])
        if not same.any():
            return order
        first = np.maximum.accumulate(np.where(same, 0, np.arange(n)))
        new = np.empty(n, np.int64)
        new[order] = first
        tied = np.flatnonzero(same | np.append(same[1:], False))
        who = order[tied]
        beyond = np.where(who + reach < n, new[np.minimum(who + reach, n - 1)], -1)
        again = np.lexsort((beyond, new[who]))
        order[tied] = who[again]
        group, beyond = new[who[again]], beyond[again]
        changed = np.concatenate([[True], (group[1:] != group[:-1]) | (beyond[1:] != beyond[:-1])])
        place = np.maximum.accumulate(np.where(changed, tied, 0))
        new[order[tied]] = place
        rank = new
        reach *= 2


SMALL_ALPHABET = 1024


def suffix_array(s: np.ndarray) -> np.ndarray:
    """s: non-negative symbols, the last one unique and smallest."""
    if len(s) == 1:
        return np.zeros(1, np.int32)
    is_s = smaller(s)
    lms = np.flatnonzero(is_s[1:] & ~is_s[:-1]).astype(np.int32) + 1
    tails = np.cumsum(np.bincount(s))
    heads = np.concatenate([[0], tails[:-1]])
    seeds = lms[np.argsort(s[lms], kind="stable")]
    rough = induce(s, is_s, seeds, heads, tails)
    marked = np.zeros(len(s), bool)
    marked[lms] = True
    order = rough[marked[rough]]
    names = named(s, lms, order)
    many = int(names.max()) + 1
    if many < len(lms):
        order = lms[suffix_array(names) if many <= SMALL_ALPHABET else by_doubling(names)]
    return induce(s, is_s, order.astype(np.int32), heads, tails)


def permuted_lcp(s: np.ndarray, sa: np.ndarray) -> np.ndarray:
    """For each suffix, the symbols (bytes) it shares with the one before it in order. Compared only where it
    can't be derived from the suffix to the left, which shares one symbol more."""
    n = len(s)
    before = np.empty(n, np.int32)
    before[sa[0]] = -1
    before[sa[1:]] = sa[:-1]
    own = np.ones(n, bool)
    follows = before[1:] > 0
    own[1:] = ~(follows & (s[:-1] == s[np.maximum(before[1:] - 1, 0)]))
    padded = np.concatenate([s.astype(np.uint8), np.zeros(8, np.uint8)])
    words = np.zeros(n, np.uint64)
    for k in range(8):
        words |= padded[k : k + n].astype(np.uint64) << np.uint64(8 * k)
    at = np.flatnonzero(own)
    a, b = at.astype(np.int64), before[at].astype(np.int64)
    length = np.zeros(len(at), np.int64)
    live = np.flatnonzero(b >= 0)
    while len(live):
        x, y = a[live] + length[live], b[live] + length[live]
        inside = (x < n) & (y < n)
        live, x, y = live[inside], x[inside], y[inside]
        off = words[x] ^ words[y]
        equal = off == 0
        low = off[~equal]
        low &= ~low + np.uint64(1)
        length[live[~equal]] += (np.bitwise_count(low - np.uint64(1)) >> 3).astype(np.int64)
        length[live[equal]] += 8
        live = live[equal]
    length = np.minimum(length, n - np.maximum(a, b))
    last = np.maximum.accumulate(np.where(own, np.arange(n), 0))
    full = np.zeros(n, np.int64)
    full[at] = length
    return full[last] - (np.arange(n) - last)
