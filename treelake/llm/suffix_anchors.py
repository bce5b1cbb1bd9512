"""Polynomial prefix hashes of byte strings, and the anchors that stand for their windows."""

from __future__ import annotations

import numpy as np

#: Two odd multipliers modulo 2 ** 64 and their inverses.
BASES = tuple(np.uint64(b) for b in (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93))
INVERSES = tuple(np.uint64(pow(int(b), -1, 1 << 64)) for b in BASES)

_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base ** i and base ** -i for i < n at least."""
    found = _powers.get(base)
    if found is None or len(found[0]) < n:
        size = max(1 << 16, 1 << (n - 1).bit_length())
        up, down = np.full(size, BASES[base]), np.full(size, INVERSES[base])
        up[0] = down[0] = 1
        found = _powers[base] = np.cumprod(up), np.cumprod(down)
    return found


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * BASES[1]
    x = (x ^ (x >> np.uint64(29))) * BASES[0]
    return x ^ (x >> np.uint64(32))


class PrefixHash:
    """Hashes of any substrings of a buffer from one table of prefix hashes."""

    def __init__(self, data: np.ndarray, base: int = 0):
        self.up, down = powers(base, len(data) + 1)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * down[: len(data)], out=self.sums[1:])
        self.top = len(data)

    def of(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        """Equal for equal substrings of this buffer and of others."""
        return (self.sums[stop] - self.sums[start]) * inverse_shift(self, start)


def inverse_shift(table: PrefixHash, start: np.ndarray) -> np.ndarray:
    return table.up[start]


def anchors(data: np.ndarray, bounds: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """The anchor of a window of `length` bytes is its first `gram`-byte string of least mixed hash, so equal windows have
    equal anchors at equal offsets. Windows stay inside the documents that bounds delimit. Returns, for each document's
    distinct anchors: document, place in data, first and last start of the windows it stands for, and its gram's hash."""
    none = (np.zeros(0, np.int64),) * 4 + (np.zeros(0, np.uint64),)
    width = length - gram + 1
    if len(data) < length:
        return none
    table = PrefixHash(data)
    at = np.arange(len(data) - gram + 1)
    hashes = (table.sums[gram:] - table.sums[:-gram]) * table.up[: len(at)]
    bits = np.uint64(max(1, int(len(data)).bit_length()))
    least = (mix(hashes) >> bits << bits) | at.astype(np.uint64)
    size = 1
    while 2 * size <= width:
        least = np.minimum(least[:-size], least[size:])
        size *= 2
    if size < width:
        least = np.minimum(least[: len(least) - (width - size)], least[width - size :])
    chosen = (least & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    starts, stops = bounds[:-1], bounds[1:]
    last = stops - length
    inside = np.flatnonzero(last >= starts)
    if not len(inside):
        return none
    counts = last[inside] - starts[inside] + 1
    document = np.repeat(inside, counts)
    window = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(starts[inside], counts)
    place = chosen[window]
    new = np.concatenate([[True], (place[1:] != place[:-1]) | (document[1:] != document[:-1])])
    first = np.flatnonzero(new)
    final = np.concatenate([first[1:], [len(place)]]) - 1
    return document[first], place[first], window[first], window[final], hashes[place[first]]
