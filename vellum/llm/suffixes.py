"""Suffix arrays by induced sorting, and permuted common prefixes.

Suffixes are classified as larger (L) or smaller (S) than their right neighbours. The leftmost S of each run (LMS)
begin substrings that are sorted, named, and, if names repeat, ordered by the suffix array of the string of names.
From their order that of all suffixes is induced in two linear scans, L from the left and S from the right. Over
bytes a scan goes bucket by bucket, each in whole numpy steps; over names it goes entry by entry.
"""

from __future__ import annotations

import numpy as np


def s_types(s: np.ndarray) -> np.ndarray:
    """True where the suffix is of type S; the last, which is the unique least character, is."""
    n = len(s)
    step = np.sign(np.diff(s.astype(np.int64)))
    where = np.where(step != 0, np.arange(n - 1), n - 1)
    after = np.minimum.accumulate(where[::-1])[::-1]
    return np.append(np.append(step, 1)[after] > 0, True) if n > 1 else np.ones(1, bool)


def induced_by_bucket(s: np.ndarray, small: np.ndarray, lms: np.ndarray, size: np.ndarray) -> np.ndarray:
    """All suffixes in order, given LMS suffixes in order (or LMS substrings, if lms is in the order of their first characters only)."""
    n, k = len(s), len(size)
    out = np.full(n, -1, np.int64)
    ends = np.cumsum(size)
    starts = ends - size
    heads = starts.copy()
    by = lms[np.argsort(s[lms], kind="stable")]
    n_lms = np.bincount(s[by], minlength=k)
    lms_of = np.split(by, np.cumsum(n_lms)[:-1])

    def put(which: np.ndarray, at: np.ndarray, down: bool) -> None:
        """Lay suffixes at the heads (or tails) of their buckets, in the order given."""
        c = s[which]
        order = np.argsort(c, kind="stable")
        which, c = which[order], c[order]
        there, first, m = np.unique(c, return_index=True, return_counts=True)
        rank = np.arange(len(c)) - np.repeat(first, m)
        if down:
            out[np.repeat(at[there], m) - 1 - rank] = which
            at[there] -= m
        else:
            out[np.repeat(at[there], m) + rank] = which
            at[there] += m

    def before(which: np.ndarray, kind: bool) -> np.ndarray:
        p = which[which > 0] - 1
        return p[small[p] == kind]

    for c in np.flatnonzero(size):
        done = starts[c]
        while done < heads[c]:
            some = out[done : heads[c]].copy()
            done = heads[c]
            if len(p := before(some, False)):
                put(p, heads, False)
        if len(p := before(lms_of[c], False)):
            put(p, heads, False)
    tails = ends.copy()
    out[0] = n - 1
    for c in np.flatnonzero(size)[::-1]:
        done = ends[c]
        while done > tails[c]:
            some = out[tails[c] : done][::-1].copy()
            done = tails[c]
            if len(p := before(some, True)):
                put(p, tails, True)
        if len(p := before(out[starts[c] : heads[c]][::-1], True)):
            put(p, tails, True)
    return out


def induced_by_entry(s: np.ndarray, small: np.ndarray, lms: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The same for large alphabets."""
    n = len(s)
    ends = np.cumsum(size)
    heads, tails = (ends - size).tolist(), ends.tolist()
    out = np.full(n, n, np.int64)
    by = lms[np.argsort(s[lms], kind="stable")]
    m = np.bincount(s[by], minlength=len(size))
    out[np.repeat(ends, m) - np.repeat(np.cumsum(m), m) + np.arange(len(by))] = by
    # by place: the bucket of the suffix before it if that is to be laid now, else -1; place n is none
    bucket = np.full(n + 1, -1, np.int64)
    bucket[1:n] = np.where(small[:-1], -1, s[:-1])
    larger = bucket.tolist()
    bucket[1:n] = np.where(small[:-1], s[:-1], -1)
    smaller = bucket.tolist()
    out = out.tolist()
    for place in out:
        c = larger[place]
        if c >= 0:
            out[heads[c]] = place - 1
            heads[c] += 1
    for place in reversed(out):
        c = smaller[place]
        if c >= 0:
            tails[c] -= 1
            out[tails[c]] = place - 1
    out[0] = n - 1
    return np.array(out, np.int64)


def induced(s: np.ndarray, k: int) -> np.ndarray:
    """The suffix array of s, whose last character is its only 0; characters are below k."""
    n = len(s)
    if n == 1:
        return np.zeros(1, np.int64)
    small = s_types(s)
    lms = np.flatnonzero(small[1:] & ~small[:-1]) + 1
    size = np.bincount(s, minlength=k)
    scan = induced_by_bucket if k <= 512 else induced_by_entry
    first = scan(s, small, lms, size)
    is_lms = np.zeros(n, bool)
    is_lms[lms] = True
    order = first[is_lms[first]]
    # names: a substring has that of the one before it if both are equal, their last characters included
    length = np.zeros(n, np.int64)
    length[lms] = np.diff(np.append(lms, n - 1)) + 1
    a, b = order[:-1], order[1:]
    same = length[a] == length[b]
    left = np.flatnonzero(same)
    step = 0
    while len(left):
        left = left[length[a[left]] > step]
        differ = s[a[left] + step] != s[b[left] + step]
        same[left[differ]] = False
        left = left[~differ]
        step += 1
    names = np.concatenate([[0], np.cumsum(~same)])
    if names[-1] + 1 < len(order):
        named = np.zeros(n, np.int64)
        named[order] = names
        order = lms[induced(named[lms], int(names[-1]) + 1)]
    return scan(s, small, order, size)


def suffix_array(data: np.ndarray) -> np.ndarray:
    """Places of the suffixes of bytes in order."""
    return induced(np.append(data.astype(np.int64) + 1, 0), 257)[1:]


def permuted_prefixes(data: np.ndarray, array: np.ndarray, most: int) -> np.ndarray:
    """By place in the text: the common prefix of its suffix with the suffix before it in order, up to ``most``.

    Along the text a prefix is one shorter than that of the place before, wherever the characters before both suffixes
    agree. Only the other places, and every ``most``-th of a stretch, are compared by characters, all at once.
    """
    n = len(data)
    before = np.full(n, -1, np.int64)
    before[array[1:]] = array[:-1]
    head = np.ones(n, bool)
    head[1:] = (before[1:] < 1) | (data[:-1] != data[np.maximum(before[1:], 1) - 1])
    place = np.arange(n)
    since = place - np.maximum.accumulate(np.where(head, place, 0))
    head |= since % most == 0
    since %= most
    at = np.flatnonzero(head)
    limit = np.minimum(2 * most, n - np.maximum(at, before[at]))
    limit[before[at] < 0] = 0
    found, left = np.zeros(len(at), np.int64), np.arange(len(at))
    step = 0
    while len(left):
        left = left[limit[left] > step]
        left = left[data[at[left] + step] == data[before[at[left]] + step]]
        found[left] = step + 1
        step += 1
    return np.minimum(np.maximum(found[np.cumsum(head) - 1] - since, 0), most)
