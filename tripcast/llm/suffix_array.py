"""Suffix arrays by induced sorting, and permuted common prefixes, as numpy passes.

``induced_order`` classifies suffixes as smaller (S) or larger (L) than the next
one, sorts the leftmost-smaller substrings, names them, orders the shorter string
of names recursively, and induces the order of all suffixes from it. Inducing
goes through the buckets of first symbols in order; what a bucket induces is
dealt to the other buckets in one pass, so the work is linear and the loop runs
over symbols, not over suffixes.

Strings of names with more than ``LOOP_SYMBOLS`` symbols would need a loop as
long as the string; there the recursion ends and ranks come from doubling.
"""

from __future__ import annotations

import numpy as np

from . import textbytes as tb

LOOP_SYMBOLS = 512


def smaller_type(s: np.ndarray) -> np.ndarray:
    """Mask: the suffix is smaller than the next one (the last symbol counts as larger than the end)."""
    n = len(s)
    out = np.zeros(n, bool)
    if n > 1:
        sign = np.zeros(n, np.int8)
        sign[:-1] = np.where(s[:-1] < s[1:], 1, np.where(s[:-1] > s[1:], -1, 0))
        sign[-1] = -1
        at = np.where(sign != 0, np.arange(n), n)
        out = sign[np.minimum.accumulate(at[::-1])[::-1]] > 0
    return out


def leftmost_smaller(small: np.ndarray) -> np.ndarray:
    """Positions of S suffixes that follow an L suffix."""
    return np.flatnonzero(small[1:] & ~small[:-1]) + 1


def _induce(s: np.ndarray, small: np.ndarray, order: np.ndarray, symbols: int) -> np.ndarray:
    """Order of all suffixes from the order of the leftmost-smaller ones."""
    n = len(s)
    size = np.bincount(s, minlength=symbols)
    end = np.cumsum(size)
    begin = end - size
    present = np.flatnonzero(size)
    sa = np.full(n, -1, np.int64)
    head, tail = begin.copy(), end.copy()
    seed = order[np.argsort(s[order], kind="stable")]
    seed_end = np.cumsum(np.bincount(s[order], minlength=symbols))
    seed_begin = np.concatenate([[0], seed_end[:-1]])

    def deal(at: np.ndarray, larger: bool, own: int) -> None:
        """Put the suffixes before ``at`` (of the wanted type) into their buckets, in order."""
        before = at[at > 0] - 1
        before = before[small[before] != larger]
        if len(before) == 0:
            return
        to = s[before]
        if len(before) > 1:
            by = np.argsort(to, kind="stable")
            before, to = before[by], to[by]
        first = np.flatnonzero(np.concatenate([[True], to[1:] != to[:-1]]))
        count = np.diff(np.append(first, len(to)))
        bucket = to[first]
        rank = np.arange(len(to)) - np.repeat(first, count)
        if larger:
            sa[np.repeat(head[bucket], count) + rank] = before
            head[bucket] += count
        else:
            sa[np.repeat(tail[bucket], count) - 1 - rank] = before
            tail[bucket] -= count

    if not small[n - 1]:  # the last suffix is the smallest that starts with its symbol
        sa[head[s[n - 1]]] = n - 1
        head[s[n - 1]] += 1
    for c in present.tolist():
        done = begin[c]
        while done < head[c]:  # what this bucket puts into itself is dealt next
            now, done = sa[done: head[c]], head[c]
            deal(now, True, c)
        if seed_end[c] > seed_begin[c]:
            deal(seed[seed_begin[c]: seed_end[c]], True, c)
    larger_end = head.copy()
    for c in present[::-1].tolist():
        done = end[c]
        while done > tail[c]:
            now, done = sa[tail[c]: done][::-1], tail[c]
            deal(now, False, c)
        if larger_end[c] > begin[c]:
            deal(sa[begin[c]: larger_end[c]][::-1], False, c)
    return sa


def _doubled(names: np.ndarray) -> np.ndarray:
    """Order of the suffixes of a string of names: ranks by 2, 4, 8 ... names, until all differ."""
    rank = names.astype(np.int64)
    n, step = len(rank), 1
    while True:
        nxt = np.zeros(n, np.int64)
        nxt[: n - step] = rank[step:] + 1
        key = rank * (int(rank.max(initial=0)) + 2) + nxt
        order = np.argsort(key)
        key = key[order]
        new = np.concatenate([[0], np.cumsum(key[1:] != key[:-1])])
        rank = np.empty(n, np.int64)
        rank[order] = new
        if new[-1] == n - 1:
            return order
        step *= 2


def induced_order(s: np.ndarray, symbols: int) -> np.ndarray:
    """Suffix array of ``s`` (symbols 0 .. symbols-1)."""
    n = len(s)
    if n < 2:
        return np.arange(n)
    small = smaller_type(s)
    lms = leftmost_smaller(small)
    if len(lms) == 0:
        return _induce(s, small, lms, symbols)
    # order the leftmost-smaller substrings: induce once from their first symbols
    near = _induce(s, small, lms, symbols)
    is_lms = np.zeros(n + 1, bool)
    is_lms[lms] = True
    ordered = near[is_lms[near]]
    # name them: equal substrings (to the next leftmost-smaller one, or the end) get equal names
    stop = np.append(lms[1:], n - 1) + 1
    number = np.empty(n, np.int64)
    number[lms] = np.arange(len(lms))
    which = number[ordered]
    values = s if s.dtype == np.uint8 else tb.mix(s.astype(np.uint64) + np.uint64(1))
    code = tb.Prefix(values).stretches(lms, stop)[which]
    length = (stop - lms)[which]
    last = which == len(lms) - 1  # ends with the string, not with a leftmost-smaller symbol
    same = (code[1:] == code[:-1]) & (length[1:] == length[:-1]) & ~last[1:] & ~last[:-1]
    name = np.concatenate([[0], np.cumsum(~same)])
    reduced = np.empty(len(lms), np.int64)
    reduced[which] = name
    count = int(name[-1]) + 1
    if count < len(lms):
        if count <= LOOP_SYMBOLS:
            order = induced_order(reduced, count)
        else:
            order = _doubled(reduced)
    else:
        order = np.argsort(reduced, kind="stable")
    return _induce(s, small, lms[order], symbols)


def permuted_common_prefixes(s: np.ndarray, sa: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """For every position, the symbols it shares with the suffix before it in the order, no further than ``stop[position]``
    (the end of its segment) on either side. Only positions whose left neighbours differ are compared; the others follow
    from the one on their left, less one symbol each."""
    n = len(s)
    if n == 0:
        return np.zeros(0, np.int64)
    before = np.full(n, -1, np.int64)
    before[sa[1:]] = sa[:-1]
    left = np.arange(n) - 1
    follows = (before > 0) & (left >= 0)
    follows[follows] = s[left[follows]] == s[before[follows] - 1]
    # a segment's first position has no left neighbour of its own
    inner = np.zeros(n, bool)
    inner[1:] = stop[1:] == stop[:-1]
    follows &= inner
    follows[follows] = inner[before[follows]]
    at = np.flatnonzero(~follows & (before >= 0))
    other = before[at]
    limit = np.minimum(stop[at] - at, stop[other] - other)
    shared = np.zeros(len(at), np.int64)
    padded = np.concatenate([s, np.zeros(8, s.dtype)])
    words = np.lib.stride_tricks.sliding_window_view(padded, 8) if s.dtype == np.uint8 else None
    live = np.flatnonzero(limit > 0)
    while len(live):
        a, b = at[live] + shared[live], other[live] + shared[live]
        if words is not None:
            x, y = words[a].view("<u8").ravel(), words[b].view("<u8").ravel()
            diff = x ^ y
            low = diff & (~diff + np.uint64(1))
            same = np.where(diff == 0, 8, np.log2(np.where(diff == 0, 1, low).astype(np.float64)).astype(np.int64) >> 3)
            shared[live] += same
            more = same == 8
        else:
            more = padded[a] == padded[b]
            shared[live] += more
        live = live[more & (shared[live] < limit[live])]
    shared = np.minimum(shared, limit)
    # carry to the right: value less distance, from the last compared position
    out = np.zeros(n, np.int64)
    out[at] = shared
    source = np.zeros(n, np.int64)
    source[~follows] = np.flatnonzero(~follows)
    source = np.maximum.accumulate(source)
    carried = out[source] - (np.arange(n) - source)
    return np.maximum(np.where(follows, carried, out), 0)
