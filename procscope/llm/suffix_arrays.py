"""Suffix order, common prefixes and longest previous factors of a bounded piece of text, in numpy.

Everything looks at the first ``depth`` bytes of a suffix only: the caller asks about matches of that
length. Positions are numbers into one array of bytes; the caller lays texts side by side and names the
positions whose ``depth`` bytes lie inside one text.
"""

from __future__ import annotations

import numpy as np


def ranks(data: np.ndarray, depth: int) -> list[tuple[int, np.ndarray]]:
    """(length, rank of the first ``length`` bytes at every position) for lengths 8, 16, 32, … up to
    ``depth`` or 8: equal strings have equal ranks and ranks follow byte order. ``data`` is read as
    if zeros followed it."""
    n = len(data)
    x = np.zeros(n + 8, np.uint64)
    x[:n] = data
    two = (x[:-1] << np.uint64(8)) | x[1:]
    four = (two[:-2] << np.uint64(16)) | two[2:]
    eight = ((four[:-4] << np.uint64(32)) | four[4:])[:n]
    r = np.unique(eight, return_inverse=True)[1].astype(np.uint64)
    out, length = [(8, r)], 8
    while length * 2 <= depth:
        r = np.unique(_pairs(r, r, length), return_inverse=True)[1].astype(np.uint64)
        length *= 2
        out.append((length, r))
    return out


def _pairs(a: np.ndarray, b: np.ndarray, shift: int) -> np.ndarray:
    """Each ``a`` with the ``b`` that stands ``shift`` places on, as one number."""
    later = np.zeros(len(b), np.uint64)
    later[: max(0, len(b) - shift)] = b[shift:]
    return (a << np.uint64(32)) | later


def suffix_order(levels: list[tuple[int, np.ndarray]], at: np.ndarray, depth: int) -> np.ndarray:
    """The positions ``at`` in the order of their first ``depth`` bytes, equal ones by position."""
    length, r = levels[-1]
    return at[np.argsort(_pairs(r, r, depth - length)[at], kind="stable")]


def common_prefixes(levels: list[tuple[int, np.ndarray]], order: np.ndarray, depth: int) -> np.ndarray:
    """Common prefix of each position with the one before it in ``order``, at most ``depth``; to eight
    bytes below that. The first is 0."""
    lcp = np.zeros(len(order), np.int64)
    if len(order) < 2:
        return lcp
    a, b = order[:-1], order[1:]
    length, top = levels[-1]
    rest = depth - length
    same = (top[a] == top[b]) & (top[a + rest] == top[b + rest])
    have = np.zeros(len(a), np.int64)
    last = len(top) - 1
    for step, r in reversed(levels):
        alike = r[np.minimum(a + have, last)] == r[np.minimum(b + have, last)]
        have += np.where(alike, step, 0)
    lcp[1:] = np.where(same, depth, np.minimum(have, depth))
    return lcp


def _nearest_smaller(order: np.ndarray, lcp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each place in ``order`` the nearest place before it with a smaller position, -1 for none,
    and the least common prefix on the way. Pointers jump over what is larger, all at once; a jump
    over a pointer that is not final yet is still over larger positions only."""
    n = len(order)
    to, low = np.arange(-1, n - 1), lcp.copy()
    open_ = np.arange(n)
    while True:
        open_ = open_[(to[open_] >= 0) & (low[open_] > 0)]
        open_ = open_[order[to[open_]] > order[open_]]
        if not len(open_):
            ends = to >= 0  # where nothing is in common the way there does not matter
            return to, np.where(ends, low, 0)
        via = to[open_]
        low[open_] = np.minimum(low[open_], low[via])
        to[open_] = to[via]


def longest_previous_factors(
    order: np.ndarray, lcp: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """(length, earlier position) per place in suffix order: the longest match of its suffix that
    starts at an earlier position, from the previous and the next smaller position."""
    n = len(order)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    before, low = _nearest_smaller(order, lcp)
    # The same from the other end: what lies between two places is held by the later one there.
    back = np.zeros(n, np.int64)
    back[1:] = lcp[:0:-1]
    after, high = _nearest_smaller(order[::-1], back)
    after, high = np.where(after >= 0, n - 1 - after, -1)[::-1], high[::-1]
    ahead = high > low
    length = np.where(ahead, high, low)
    place = np.where(ahead, after, before)
    return length, np.where(length > 0, order[place], -1)


def repeats(data: np.ndarray, at: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(later, any) for the positions ``at``, ascending: does an earlier one of them start with the
    same ``depth`` bytes; does any other."""
    if not len(at):
        return np.zeros(0, bool), np.zeros(0, bool)
    levels = ranks(data, depth)
    order = suffix_order(levels, at, depth)
    length, source = longest_previous_factors(order, common_prefixes(levels, order, depth))
    hit = length >= depth
    later = np.zeros(len(data), bool)
    later[order[hit]] = True
    either = later.copy()
    either[source[hit]] = True  # the first of several equal ones is the source of another
    return later[at], either[at]
