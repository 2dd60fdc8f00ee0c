"""Burkhard-Keller trees over 64-bit fingerprints, built and searched level by level in numpy.

A forest holds one tree per bucket; a node's children are keyed by their integer Hamming distance
to it, and a search follows only edges within the radius of the query's distance to the node.
"""

from __future__ import annotations

import numpy as np

_EDGES = 65


def distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).astype(np.int64)


class Forest:
    """One tree for every value of ``bucket`` (integers from 0) over distinct fingerprints ``points``."""

    def __init__(self, points: np.ndarray, bucket: np.ndarray) -> None:
        self.points = points
        n = len(points)
        self.roots = np.full(int(bucket.max(initial=-1)) + 1, -1, dtype=np.int64)
        keys, nodes = [], []
        # each open point sits below some node by a key; the first point of a key becomes that child
        open_, key = np.arange(n), bucket.astype(np.int64)
        top = True
        while len(open_):
            order = np.argsort(key, kind="stable")
            open_, key = open_[order], key[order]
            first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            child = open_[first]
            if top:
                self.roots[key[first]] = child
                top = False
            else:
                keys.append(key[first])
                nodes.append(child)
            below = np.repeat(child, np.diff(np.r_[first, len(open_)]))
            rest = np.ones(len(open_), dtype=bool)
            rest[first] = False
            open_, below = open_[rest], below[rest]
            key = below * _EDGES + distance(self.points[open_], self.points[below])
        self.keys = np.concatenate(keys) if keys else np.zeros(0, dtype=np.int64)
        self.nodes = np.concatenate(nodes) if nodes else np.zeros(0, dtype=np.int64)
        order = np.argsort(self.keys, kind="stable")
        self.keys, self.nodes = self.keys[order], self.nodes[order]

    def within(self, queries: np.ndarray, bucket: np.ndarray, radius: int, slice_: int = 4096):
        """Yields ``(query index, point index)`` arrays of all matches, some queries at a time."""
        for start in range(0, len(queries), slice_):
            q = np.arange(start, min(start + slice_, len(queries)))
            b = bucket[q]
            known = b < len(self.roots)
            node = np.where(known, self.roots[np.minimum(b, len(self.roots) - 1)], -1) if len(self.roots) else np.full(len(q), -1)
            q, node = q[node >= 0], node[node >= 0]
            while len(q):
                d = distance(queries[q], self.points[node])
                hit = d <= radius
                if hit.any():
                    yield q[hit], node[hit]
                low = np.searchsorted(self.keys, node * _EDGES + np.maximum(d - radius, 1))
                high = np.searchsorted(self.keys, node * _EDGES + np.minimum(d + radius, _EDGES - 1), side="right")
                n = high - low
                at = np.repeat(low - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())
                q, node = np.repeat(q, n), self.nodes[at]


class Union:
    """Smallest member of each class, by union-find over positions; whole arrays of links at a time."""

    def __init__(self, n: int) -> None:
        self.parent = np.arange(n)

    def roots(self) -> np.ndarray:
        while True:
            up = self.parent[self.parent]
            if np.array_equal(up, self.parent):
                return up
            self.parent = up

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            p = self.roots()
            a, b = p[a], p[b]
            differ = a != b
            a, b = a[differ], b[differ]
            np.minimum.at(self.parent, np.maximum(a, b), np.minimum(a, b))
