"""Suffix arrays by induced sorting, and permuted common prefixes, over one shard of bytes.

Suffixes are L or S by comparing them with the next one. Leftmost S suffixes cut the text
into substrings; those are sorted by inducing, named, and the string of names is sorted by
recursion where names repeat. From the sorted leftmost S suffixes all others are induced in
linear time. Over bytes the inducing passes handle a bucket at a time in array operations;
over names, whose buckets are small, they run one suffix at a time.
"""

from __future__ import annotations

import numpy as np


def classify(t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(is S, places of leftmost S suffixes); t ends in a unique least symbol, which is S."""
    n = len(t)
    rise = np.sign(t[1:].astype(np.int64) - t[:-1])
    place = np.where(rise != 0, np.arange(n - 1), n)
    nearest = np.minimum.accumulate(place[::-1])[::-1]  # of the next symbol that differs
    s = np.ones(n, bool)
    s[:-1] = rise[np.minimum(nearest, n - 2)] > 0
    return s, np.flatnonzero(s[1:] & ~s[:-1]) + 1


def _deal(items: np.ndarray, t: np.ndarray, into: list[list[np.ndarray]]) -> None:
    """Appends items, in order, to the bucket of their first symbol."""
    if not len(items):
        return
    first = t[items]
    order = np.argsort(first, kind="stable")
    first, items = first[order], items[order]
    cuts = np.flatnonzero(np.diff(first)) + 1
    for c, part in zip(first[np.concatenate([[0], cuts])].tolist(), np.split(items, cuts)):
        into[c].append(part)


def _none() -> np.ndarray:
    return np.empty(0, np.int64)


def _join(parts: list[np.ndarray]) -> np.ndarray:
    return parts[0] if len(parts) == 1 else np.concatenate(parts) if parts else _none()


def induce_by_bucket(t: np.ndarray, k: int, s: np.ndarray, lms: np.ndarray) -> np.ndarray:
    """All suffixes in order, from the leftmost S suffixes in order (of each bucket); t has few symbols."""
    seeds: list[list[np.ndarray]] = [[] for _ in range(k)]
    _deal(lms, t, seeds)
    todo: list[list[np.ndarray]] = [[] for _ in range(k)]
    ls: list[np.ndarray] = []
    for c in range(k):
        now, mine, out = _join(todo[c]), [], []
        while len(now):  # L suffixes of this bucket, those they put before themselves last
            mine.append(now)
            before = now[now > 0] - 1
            before = before[~s[before]]
            same = t[before] == c
            out.append(before[~same])
            now = before[same]
        seed = _join(seeds[c])
        out.append(seed[seed > 0] - 1)
        ls.append(_join(mine))
        _deal(_join(out), t, todo)
    todo = [[] for _ in range(k)]
    parts: list[np.ndarray] = []
    for c in range(k - 1, -1, -1):  # mirrored: from the right end of each bucket
        now, mine, out = _join(todo[c]), [], []
        while len(now):
            mine.append(now)
            before = now[now > 0] - 1
            before = before[s[before]]
            same = t[before] == c
            out.append(before[~same])
            now = before[same]
        before = ls[c][::-1]
        before = before[before > 0] - 1
        out.append(before[s[before]])
        parts += [_join(mine), ls[c][::-1]]
        _deal(_join(out), t, todo)
    sa = _join(parts)[::-1]
    return sa if len(sa) == len(t) else np.concatenate([[len(t) - 1], sa])  # the end symbol precedes nothing


def induce_one_by_one(t: list[int], k: int, s: list[bool], lms: list[int]) -> list[int]:
    n = len(t)
    size = [0] * (k + 1)
    for c in t:
        size[c + 1] += 1
    for c in range(k):
        size[c + 1] += size[c]
    head, tail = size[:k], size[1 : k + 1]
    sa, end = [-1] * n, tail[:]
    for i in reversed(lms):
        c = t[i]
        end[c] -= 1
        sa[end[c]] = i
    for x in range(n):
        j = sa[x] - 1
        if j >= 0 and not s[j]:
            c = t[j]
            sa[head[c]] = j
            head[c] += 1
    for x in range(n - 1, -1, -1):
        j = sa[x] - 1
        if j >= 0 and s[j]:
            c = t[j]
            tail[c] -= 1
            sa[tail[c]] = j
    return sa


def suffix_array(t: np.ndarray, k: int) -> np.ndarray:
    """Of symbols 0..k-1; the last symbol is the only 0."""
    n = len(t)
    if n == 1:
        return np.zeros(1, np.int64)
    s, lms = classify(t)
    wide = k <= 512
    lists = None if wide else (t.tolist(), s.tolist())

    def induce(order: np.ndarray) -> np.ndarray:
        return induce_by_bucket(t, k, s, order) if wide else np.array(induce_one_by_one(lists[0], k, lists[1], order.tolist()), np.int64)

    is_lms = np.zeros(n, bool)
    is_lms[lms] = True
    found = induce(lms)
    found = found[is_lms[found]]  # substrings in order
    end = np.full(n, n - 1)
    end[lms[:-1]] = lms[1:]
    a, b = found[:-1], found[1:]
    size = end[found] - found + 1
    equal = size[:-1] == size[1:]
    at = np.flatnonzero(equal)
    if len(at):  # all symbols of neighbouring substrings of equal length
        m = size[at]
        first = np.cumsum(m) - m
        step = np.arange(int(m.sum())) - np.repeat(first, m)
        equal[at] = np.logical_and.reduceat(t[np.repeat(a[at], m) + step] == t[np.repeat(b[at], m) + step], first)
    name = np.empty(n, np.int64)
    name[found] = np.concatenate([[0], np.cumsum(~equal)])
    names = name[lms]
    distinct = int(names.max()) + 1
    order = lms[suffix_array(names, distinct)] if distinct < len(lms) else found
    return induce(order)


def common_prefixes(raw: np.ndarray, sa: np.ndarray) -> np.ndarray:
    """For each suffix of raw (sa without the end symbol), bytes shared with the one before it in sa.

    Computed in text order: where a suffix and its predecessor are preceded by equal bytes the
    value is one less than its left neighbour's, so only the others are compared, eight bytes
    at a time.
    """
    n = len(raw)
    before = np.full(n, -1)
    before[sa[1:]] = sa[:-1]
    here = np.arange(n)
    left, right = np.maximum(here - 1, 0), np.maximum(before - 1, 0)
    must = (here == 0) | (before <= 0) | (raw[left] != raw[right])
    padded = np.concatenate([raw, np.zeros(16, np.uint8)])
    eight = np.lib.stride_tricks.as_strided(padded.view(np.uint8), (n + 8, 8), (1, 1))
    words = np.ascontiguousarray(eight).view(np.uint64).ravel()
    i = np.flatnonzero(must & (before >= 0))
    j, same = before[i], np.zeros(len(i), np.int64)
    todo = np.arange(len(i))
    while len(todo):
        x, y = i[todo] + same[todo], j[todo] + same[todo]
        inside = np.maximum(x, y) < n
        todo, x, y = todo[inside], x[inside], y[inside]
        diff = words[x] ^ words[y]
        whole = diff == 0
        low = diff & (~diff + np.uint64(1))
        same[todo] += np.where(whole, 8, np.bitwise_count(low - np.uint64(1)).astype(np.int64) // 8)
        todo = todo[whole]
    same = np.minimum(same, n - np.maximum(i, j))
    start = np.full(n, -1)
    value = np.zeros(n, np.int64)
    value[i] = same
    start[must] = here[must]
    start = np.maximum.accumulate(start)
    return np.maximum(value[start] - (here - start), 0)
