"""Suffix arrays by induced sorting, in whole-array steps."""

from __future__ import annotations

import numpy as np


def _types(s: np.ndarray) -> np.ndarray:
    """True where a suffix is smaller than the next one; the last one counts as smaller."""
    n = len(s)
    rises = np.empty(n, np.int8)
    rises[:-1] = np.where(s[:-1] < s[1:], 1, np.where(s[:-1] > s[1:], 0, -1))
    rises[-1] = 1
    at = np.where(rises >= 0, np.arange(n), n)
    return rises[np.minimum.accumulate(at[::-1])[::-1]].astype(bool)


def _rank_within(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rank of each element among the equal ones before it; the distinct keys and their counts."""
    order = np.argsort(keys, kind="stable")
    ordered = keys[order]
    first = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
    counts = np.diff(np.append(first, len(keys)))
    rank = np.empty(len(keys), np.int64)
    rank[order] = np.arange(len(keys)) - np.repeat(first, counts)
    return rank, ordered[first], counts


def _induce(s: np.ndarray, smaller: np.ndarray, sa: np.ndarray, edge: np.ndarray, waits: np.ndarray, kind: bool) -> None:
    """Scan the array and put the predecessor of each suffix met into its bucket.

    kind False: left to right, larger suffixes to the fronts of their buckets; True: right to left, smaller
    suffixes to the ends.  ``waits`` marks slots still to be filled; everything up to the next such slot is known and
    nothing found in it can land before that slot, so the whole stretch is handled at once.
    """
    n, i, step = len(sa), 0, 256
    view, waiting = (sa[::-1], waits[::-1]) if kind else (sa, waits)
    while i < n:
        hole = waiting[i : i + step]
        stop = int(hole.argmax())
        if hole[stop]:
            if not stop:
                raise AssertionError("a suffix was not induced")
            e = i + stop
            step = max(256, 2 * stop)
        else:
            e = min(n, i + step)
            step = min(step * 2, 1 << 17)
        before = view[i:e]
        before = before[before > 0] - 1
        before = before[smaller[before] == kind]
        i = e
        if not len(before):
            continue
        c = s[before]
        rank, keys, counts = _rank_within(c)
        if kind:
            slot = edge[c] - 1 - rank
            edge[keys] -= counts
        else:
            slot = edge[c] + rank
            edge[keys] += counts
        sa[slot] = before
        waits[slot] = False


def suffix_array(s: np.ndarray, letters: int) -> np.ndarray:
    """Order of the suffixes of s, whose last symbol is 0 and occurs only there.

    Suffixes are classified; leftmost-smaller substrings are sorted by inducing, named, and the string of names is
    sorted recursively unless all names differ; the suffixes at them, in order, induce all others.
    """
    n = len(s)
    if n == 1:
        return np.zeros(1, np.int64)
    smaller = _types(s)
    leftmost = np.flatnonzero(smaller[1:] & ~smaller[:-1]) + 1
    counts = np.bincount(s, minlength=letters)
    ends = np.cumsum(counts)
    starts = ends - counts
    large = np.bincount(s[~smaller], minlength=letters)
    bucket_first = np.repeat(starts, counts)
    is_large_slot = np.arange(n) - bucket_first < np.repeat(large, counts)

    def induced(order: np.ndarray) -> np.ndarray:
        sa = np.full(n, -1, np.int64)
        rank, _, _ = _rank_within(s[order][::-1])
        sa[ends[s[order]] - 1 - rank[::-1]] = order
        _induce(s, smaller, sa, starts.copy(), is_large_slot.copy(), False)
        sa[~is_large_slot] = -1
        sa[0] = n - 1
        waits = ~is_large_slot
        waits[0] = False
        edge = ends.copy()
        _induce(s, smaller, sa, edge, waits, True)
        return sa

    sa = induced(leftmost)
    is_leftmost = np.zeros(n, bool)
    is_leftmost[leftmost] = True
    ordered = sa[is_leftmost[sa]]
    number = np.empty(n, np.int64)
    number[leftmost] = np.arange(len(leftmost))
    length = np.diff(np.append(leftmost, n))[number[ordered]] + 1
    same = length[1:] == length[:-1]
    a, b, need = ordered[:-1][same], ordered[1:][same], length[1:][same]
    alive, k = np.flatnonzero(same), 0
    while len(a):
        alike = (s[np.minimum(a + k, n - 1)] == s[np.minimum(b + k, n - 1)]) & (np.maximum(a, b) + k < n)
        same[alive[~alike]] = False
        k += 1
        go = alike & (k < need)
        a, b, need, alive = a[go], b[go], need[go], alive[go]
    name = np.concatenate([[0], np.cumsum(~same)]) if len(ordered) else np.zeros(0, np.int64)
    if len(name) and name[-1] + 1 < len(name):
        names = np.empty(len(leftmost), np.int64)
        names[number[ordered]] = name
        ordered = leftmost[suffix_array(names, int(name[-1]) + 1)]
    return induced(ordered)


def permuted_common_prefixes(data: np.ndarray, sa: np.ndarray) -> np.ndarray:
    """For each place, how long its suffix agrees with the one before it in the order.

    Only places whose left neighbours differ are compared, eight bytes at a time; from each of them on the value falls
    by one a place.  data: the bytes without the closing symbol; sa: the order of the suffixes with it.
    """
    n = len(data)
    before = np.full(n + 1, -1, np.int64)
    before[sa[1:]] = sa[:-1]
    before = before[:n]
    place = np.arange(n)
    left = np.where((place > 0) & (before > 0), data[place - 1] == data[before - 1], False)
    start = np.flatnonzero(~left)
    padded = np.concatenate([data, np.zeros(8, np.uint8)]).astype(np.uint64)
    word = np.zeros(n + 1, np.uint64)
    for k in range(8):
        word |= padded[k : k + n + 1] << np.uint64(8 * k)
    common = np.zeros(len(start), np.int64)
    alive = np.flatnonzero((before[start] >= 0) & (before[start] < n))
    while len(alive):
        a, b = start[alive] + common[alive], before[start[alive]] + common[alive]
        inside = np.minimum(n - a, n - b)
        apart = word[np.minimum(a, n)] ^ word[np.minimum(b, n)]
        low = apart & (~apart + np.uint64(1))
        agree = np.where(apart == 0, 8, np.log2(np.maximum(low, np.uint64(1)).astype(np.float64)).astype(np.int64) // 8)
        gain = np.minimum(agree, inside)
        common[alive] += gain
        alive = alive[(gain == 8) & (inside > 8)]
    value = np.zeros(n, np.int64)
    value[start] = common + start
    return np.maximum(np.maximum.accumulate(np.where(left, 0, value)) - place, 0) if n else value
