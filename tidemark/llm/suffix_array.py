"""Suffix arrays and longest-previous-factor arrays of bounded byte strings, in whole-array numpy steps."""

from __future__ import annotations

import numpy as np

_WORD = 8


class Suffixes:
    """Suffix order of ``data`` down to ``depth`` bytes, by prefix doubling.

    Suffixes alike in their first ``depth`` bytes are ordered by position.  Behind its end the text
    goes on with zero bytes; callers pass as ``starts`` only positions with ``depth`` bytes to go where that matters.
    """

    def __init__(self, data: bytes, depth: int) -> None:
        self.n, self.depth = len(data), max(depth, _WORD)
        padded = np.frombuffer(data + bytes(_WORD), dtype=np.uint8).astype(np.uint64)
        first = np.zeros(self.n, dtype=np.uint64)
        for i in range(_WORD):
            first |= padded[i : i + self.n] << np.uint64(8 * (_WORD - 1 - i))
        self.ranks = [(_WORD, self._rank(first))]
        while 2 * self.ranks[-1][0] <= self.depth:
            size, rank = self.ranks[-1]
            self.ranks.append((2 * size, self._joined(rank, size)))
        size, rank = self.ranks[-1]
        self.full = rank if size == self.depth else self._joined(rank, self.depth - size)

    @staticmethod
    def _rank(key: np.ndarray) -> np.ndarray:
        return np.unique(key, return_inverse=True)[1].astype(np.int64)

    def _joined(self, rank: np.ndarray, step: int) -> np.ndarray:
        later = np.full(self.n, 0, dtype=np.int64)
        later[: max(self.n - step, 0)] = rank[step:] + 1
        return self._rank(rank * (self.n + 2) + later)

    def order(self, starts: np.ndarray) -> np.ndarray:
        """``starts`` (ascending) in suffix order."""
        return starts[np.argsort(self.full[starts], kind="stable")]

    def common(self, a: np.ndarray, b: np.ndarray, least: int = 0) -> np.ndarray:
        """Longest common prefixes of suffixes, to the depth at most and in steps of eight bytes below it; 0 for those under ``least``."""
        a, b, out = a.copy(), b.copy(), np.zeros(len(a), dtype=np.int64)
        whole = self.full[a] == self.full[b]
        if least >= self.depth:
            return np.where(whole, self.depth, 0)
        for size, rank in reversed(self.ranks):
            inside = np.maximum(a, b) < self.n
            same = np.zeros(len(a), dtype=bool)
            same[inside] = rank[a[inside]] == rank[b[inside]]
            step = size * same
            a, b, out = a + step, b + step, out + step
        out = np.where(whole, self.depth, np.minimum(out, self.depth - 1))
        return np.where(out >= least, out, 0)


def nearest_smaller(values: np.ndarray, common: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each place the nearest earlier place of smaller value (-1: none) and the least ``common`` on the way.

    ``common[i]`` belongs between places i - 1 and i.  Every place first looks at its neighbour; while that
    one is not smaller it goes on to the place its neighbour looks at, all places at once.  A way with nothing
    in common ends there, as no place behind it has more: -1 and 0.
    """
    n = len(values)
    at, least = np.where(common > 0, np.arange(n) - 1, -1), common.copy()
    while True:
        todo = np.flatnonzero(at >= 0)
        todo = todo[values[at[todo]] >= values[todo]]
        if not len(todo):
            return at, np.where(at >= 0, least, 0)
        via = at[todo]
        least[todo] = np.minimum(least[todo], least[via])
        at[todo] = at[via]


def previous_factors(suffixes: Suffixes, starts: np.ndarray, least: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """For each of ``starts`` (ascending) the longest match with an earlier and with a later one of them; 0 for matches under ``least``.

    An earlier match of a suffix is longest at the previous or at the next smaller position in suffix
    order; a later one at the previous or next greater position.
    """
    if not len(starts):
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    order = suffixes.order(starts)
    step = np.zeros(len(order), dtype=np.int64)
    step[1:] = suffixes.common(order[:-1], order[1:], least)
    back, turned = np.r_[0, step[1:][::-1]], order[::-1]
    place = np.argsort(order, kind="stable")
    out = []
    for sign in (1, -1):
        before = nearest_smaller(sign * order, step)[1]
        after = nearest_smaller(sign * turned, back)[1][::-1]
        out.append(np.maximum(before, after)[place])
    return out[0], out[1]
