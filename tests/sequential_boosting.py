"""Boosted quantile trees for one training set held whole, to compare the distributed ones with."""

import math

import numpy as np

from tidemark.functions import scoring as sc

LEVELS = np.array(sc.QUANTILE_LEVELS)


def nearest(values, q):
    """The value of rank ceil(q n)."""
    return np.sort(values)[max(math.ceil(q * len(values)), 1) - 1]


def gain(n, below):
    return float(((LEVELS * n - below) ** 2 / (n * LEVELS * (1 - LEVELS))).sum())


def split(bins, under, min_leaf):
    best = None
    for f in range(bins.shape[1]):
        for b in np.unique(bins[:, f])[:-1]:
            left = bins[:, f] <= b
            n = left.sum()
            if min(n, len(left) - n) < min_leaf:
                continue
            g = round(gain(n, under[left].sum(0)) + gain(len(left) - n, under[~left].sum(0)) - gain(len(left), under.sum(0)), 6)
            if g > 0 and (best is None or g > best[0]):
                best = g, f, b
    return best


def boosted(x, y, now, n_trees, depth=2, rate=0.2, n_bins=32, min_leaf=20):
    edges = [np.array([nearest(x[:, f], (i + 1) / n_bins) for i in range(n_bins - 1)]) for f in range(x.shape[1])]
    to_bins = lambda v: np.column_stack([np.searchsorted(e, v[:, f], side="left") for f, e in enumerate(edges)])
    bins, asked = to_bins(x), to_bins(now)
    base = np.array([nearest(y, q) for q in LEVELS])
    pred, out = np.tile(base, (len(y), 1)), np.tile(base, (len(now), 1))

    def grow(rows, at, d):
        if not len(rows):
            return
        found = split(bins[rows], y[rows, None] < pred[rows], min_leaf) if d else None
        if found:
            _, f, b = found
            grow(rows[bins[rows, f] <= b], at[asked[at, f] <= b], d - 1)
            grow(rows[bins[rows, f] > b], at[asked[at, f] > b], d - 1)
            return
        step = np.array([rate * nearest(y[rows] - pred[rows, q], LEVELS[q]) for q in range(len(LEVELS))])
        steps.append((rows, at, step))

    for _ in range(n_trees):
        steps = []
        grow(np.arange(len(y)), np.arange(len(now)), depth)
        for rows, at, step in steps:
            pred[rows] += step
            out[at] += step
    return np.sort(out, axis=1)
