"""Mergesort of suffixes that compares them by hashes of their prefixes."""

from __future__ import annotations

import numpy as np

from .suffix_anchors import PrefixHash


def common(table: PrefixHash, x: np.ndarray, y: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Length of the common prefix of the suffixes at x and y, at most `most`, by binary search over prefix hashes."""
    low, high = np.zeros_like(most), most.copy()
    while True:
        open_ = np.flatnonzero(low < high)
        if not len(open_):
            return low
        middle = (low[open_] + high[open_] + 1) >> 1
        a, b = x[open_], y[open_]
        same = table.of(a, a + middle) == table.of(b, b + middle)
        low[open_[same]] = middle[same]
        high[open_[~same]] = middle[~same] - 1


def below(table: PrefixHash, data: np.ndarray, x: tuple, y: tuple, ties: np.ndarray) -> np.ndarray:
    """Whether suffix x (starts, lengths) comes before y; ties decides for equal ones."""
    most = np.minimum(x[1], y[1])
    shared = common(table, x[0], y[0], most)
    ended = shared == most
    last = len(data) - 1
    by_byte = data[np.minimum(x[0] + shared, last)] < data[np.minimum(y[0] + shared, last)]
    return np.where(ended, np.where(x[1] == y[1], ties, x[1] < y[1]), by_byte)


def suffix_order(table: PrefixHash, data: np.ndarray, start: np.ndarray, length: np.ndarray, group: np.ndarray) -> np.ndarray:
    """The order of the suffixes by group (ascending already), then by their bytes: a bottom-up mergesort of all groups at
    once, in which an element's place is its own rank plus its rank in the neighbour run, found by binary search."""
    n = len(start)
    order = np.arange(n)
    if not n:
        return order
    new = np.concatenate([[True], group[1:] != group[:-1]])
    first = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    size = np.diff(np.concatenate([np.flatnonzero(new), [n]]))
    end = first + np.repeat(size, size)
    width = 1
    while width < size.max():
        at = np.flatnonzero(end - first > width)
        inner = at - first[at]
        run = inner // width
        low = np.minimum(first[at] + (run ^ 1) * width, end[at])
        base, high = low.copy(), np.minimum(low + width, end[at])
        me, right = order[at], (run & 1) == 1
        while True:
            open_ = np.flatnonzero(low < high)
            if not len(open_):
                break
            middle = (low[open_] + high[open_]) >> 1
            other, own = order[middle], me[open_]
            less = below(table, data, (start[other], length[other]), (start[own], length[own]), right[open_])
            low[open_[less]] = middle[less] + 1
            high[open_[~less]] = middle[~less]
        place = first[at] + (run >> 1) * 2 * width + inner % width + (low - base)
        following = order.copy()
        following[place] = me
        order = following
        width *= 2
    return order


def neighbours(table: PrefixHash, data: np.ndarray, start: np.ndarray, length: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of suffix_order, and the common prefix of each suffix with the one before it (0 across groups). Hashes
    are checked against the bytes; where they misled, the suffixes are sorted again by their bytes."""
    order = suffix_order(table, data, start, length, group)
    for again in (False, True):
        if again:
            raw = data.tobytes()
            order = np.array(sorted(range(len(start)), key=lambda k: (group[k], raw[start[k] : start[k] + length[k]])), np.int64)
        a, b = order[:-1], order[1:]
        most = np.where(group[a] == group[b], np.minimum(length[a], length[b]), 0)
        shared, right = np.zeros(len(most), np.int64), True
        span = np.arange(int(length.max(initial=0)) + 1)
        for k in range(0, len(most), 1 << 14):
            part = slice(k, k + (1 << 14))
            inside = span < most[part][:, None]
            last = len(data) - 1
            x = data[np.minimum(start[a[part]][:, None] + span, last)]
            y = data[np.minimum(start[b[part]][:, None] + span, last)]
            shared[part] = np.argmin(inside & (x == y), axis=1)
            rows, at = np.arange(len(x)), shared[part]
            grouped = group[a[part]] == group[b[part]]
            ordered = np.where(at == most[part], length[a[part]] <= length[b[part]], x[rows, at] < y[rows, at])
            right = right and bool(ordered[grouped].all())
        if right:
            break
    return order, np.concatenate([[0], shared]) if len(order) else shared
