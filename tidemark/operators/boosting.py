"""Boosted trees of quantiles, fitted for many training sets at once.

A model is one training set (a refit date and a horizon).  All models grow their next tree in the same passes over the examples: a pass
turns every split of the table into one histogram of counts by (model, node, feature, bin), the histograms are added up
in one shuffle, and cumulative counts per feature give the gain of every threshold.  One tree serves all levels; its leaves hold one
step per level, the residuals' own quantile there, found by mergeable sketches.

Histograms count rows and, per level, outcomes below the present quantile, so sums are whole numbers and do not depend on the order
of rows.  Trees, bin edges and best splits are as many as models, trees and nodes, never as rows; they are what the driver holds.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark.functions import scoring as sc
from tidemark.session import settled

LEVELS = sc.QUANTILE_LEVELS


@dataclass
class Forest:
    """Trees of every model.  Node ``i`` has children ``2i + 1`` (bin at most ``at``) and ``2i + 2``."""

    edges: np.ndarray  # model, feature, edge
    base: np.ndarray  # model, level
    n: np.ndarray  # examples of each model; a model without any has no forecast
    depth: int
    feature: list[np.ndarray] = field(default_factory=list)  # one a tree: model, inner node
    at: list[np.ndarray] = field(default_factory=list)
    leaf: list[np.ndarray] = field(default_factory=list)  # model, leaf, level

    def bins(self, model: np.ndarray, x: np.ndarray) -> np.ndarray:
        """How many edges of its model lie below each value."""
        out = np.zeros(x.shape, dtype=np.int16)
        for m in np.unique(model):
            here = model == m
            for f in range(x.shape[1]):
                out[here, f] = np.searchsorted(self.edges[m, f], x[here, f], side="left")
        return out

    def node(self, model: np.ndarray, bins: np.ndarray, feature: np.ndarray, at: np.ndarray, depth: int) -> np.ndarray:
        node, row = np.zeros(len(model), dtype=np.int64), np.arange(len(model))
        for _ in range(depth):
            node = 2 * node + 1 + (bins[row, feature[model, node]] > at[model, node])
        return node

    def quantiles(self, model: np.ndarray, bins: np.ndarray) -> np.ndarray:
        out, first = self.base[model].copy(), 2**self.depth - 1
        for feature, at, leaf in zip(self.feature, self.at, self.leaf):
            out += leaf[model, self.node(model, bins, feature, at, self.depth) - first]
        return out


def _gain(n: Column, below: Sequence[Column]) -> Column:
    """How far a group's outcomes are from having each level's share below its quantile: squared z-scores, summed."""
    return sum((((F.lit(q) * n - b) * (F.lit(q) * n - b)) / (n * F.lit(q * (1 - q))) for q, b in zip(LEVELS, below)), F.lit(0.0))


def best_splits(histogram: DataFrame, min_leaf: int) -> DataFrame:
    """``model, node, feature, bin`` of the greatest gain, first feature and bin on ties; nodes without a split that gains are absent.

    ``histogram``: ``model, node, feature, bin, n, b0 ...`` with one row per bin that holds examples.
    """
    below = [f"b{i}" for i in range(len(LEVELS))]
    of = Window.partitionBy("model", "node", "feature")
    upto = of.orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cut = histogram.select(
        "model", "node", "feature", "bin",
        *[F.sum(c).over(upto).cast("double").alias(f"l_{c}") for c in ("n", *below)],
        *[F.sum(c).over(of).cast("double").alias(f"a_{c}") for c in ("n", *below)],
    ).filter((F.col("l_n") >= min_leaf) & (F.col("a_n") - F.col("l_n") >= min_leaf))
    left = _gain(F.col("l_n"), [F.col(f"l_{c}") for c in below])
    right = _gain(F.col("a_n") - F.col("l_n"), [F.col(f"a_{c}") - F.col(f"l_{c}") for c in below])
    whole = _gain(F.col("a_n"), [F.col(f"a_{c}") for c in below])
    gained = cut.withColumn("gain", F.round(left + right - whole, 6)).filter("gain > 0")
    best = gained.groupBy("model", "node").agg(F.max(F.struct("gain", (-F.col("feature")).alias("f"), (-F.col("bin")).alias("b"))).alias("_s"))
    return best.select("model", "node", (-F.col("_s.f")).alias("feature"), (-F.col("_s.b")).alias("bin"))


def fit_forest(
    examples: DataFrame, n_models: int, n_features: int, *, n_trees: int = 20, depth: int = 2, rate: float = 0.2, n_bins: int = 32, min_leaf: int = 20
) -> Forest:
    """``examples``: ``model`` (0 up to ``n_models``), ``x`` (array without nulls) and ``y``.

    A tree takes ``depth + 1`` passes over the binned examples, with one small shuffle each.  A pass works the earlier trees out again, which costs a few array look-ups a
    row and saves writing the examples once a tree.  Memory in a task: one histogram of all models.
    """
    levels = F.array(*[F.lit(q) for q in LEVELS])
    inner = F.array(*[F.lit((i + 1) / n_bins) for i in range(n_bins - 1)])
    rows = settled(examples.select("model", *[F.col("x")[f].alias(f"x{f}") for f in range(n_features)], F.col("y").cast("double").alias("y")), "examples")
    shape = rows.groupBy("model").agg(
        F.count(F.lit(1)).alias("n"), F.percentile_approx("y", levels).alias("base"),
        F.array(*[F.percentile_approx(f"x{f}", inner) for f in range(n_features)]).alias("edges"),
    )
    forest = Forest(np.full((n_models, n_features, n_bins - 1), np.inf), np.full((n_models, len(LEVELS)), np.nan), np.zeros(n_models, dtype=np.int64), depth)
    for r in shape.collect():
        forest.edges[r["model"]], forest.base[r["model"]], forest.n[r["model"]] = np.array(r["edges"]), np.array(r["base"]), r["n"]
    names = [f"x{f}" for f in range(n_features)]
    binned = settled(rows.mapInPandas(_binner(forest, names), f"model int, {', '.join(f'{c} short' for c in names)}, y double"), "binned")
    for _ in range(n_trees):
        feature, at = np.zeros((n_models, 2**depth - 1), dtype=np.int64), np.full((n_models, 2**depth - 1), n_bins)
        for d in range(depth):
            counts = binned.mapInPandas(_counter(forest, names, feature, at, d, n_models, n_bins), _HISTOGRAM)
            whole = counts.groupBy("model", "node", "feature", "bin").agg(*[F.sum(c).alias(c) for c in ("n", *[f"b{i}" for i in range(len(LEVELS))])])
            for r in best_splits(whole, min_leaf).collect():
                feature[r["model"], r["node"]], at[r["model"], r["node"]] = r["feature"], r["bin"]
        residuals = binned.mapInPandas(_leftover(forest, names, feature, at), _RESIDUALS)
        steps = residuals.groupBy("model", "leaf").agg(*[F.percentile_approx(f"r{i}", F.lit(q)).alias(f"r{i}") for i, q in enumerate(LEVELS)])
        leaf = np.zeros((n_models, 2**depth, len(LEVELS)))
        for r in steps.collect():
            leaf[r["model"], r["leaf"]] = [rate * r[f"r{i}"] for i in range(len(LEVELS))]
        forest.feature.append(feature)
        forest.at.append(at)
        forest.leaf.append(leaf)
    return forest


_HISTOGRAM = "model int, node int, feature int, bin int, n long, " + ", ".join(f"b{i} long" for i in range(len(LEVELS)))
_RESIDUALS = "model int, leaf int, " + ", ".join(f"r{i} double" for i in range(len(LEVELS)))


def _binner(forest: Forest, names: list[str]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            bins = forest.bins(b["model"].to_numpy(), b[names].to_numpy(dtype=float))
            yield pd.DataFrame({"model": b["model"], **{c: bins[:, f] for f, c in enumerate(names)}, "y": b["y"]})

    return run


def _counter(forest: Forest, names: list[str], feature: np.ndarray, at: np.ndarray, d: int, n_models: int, n_bins: int):
    k, nodes, first = len(names), 2**d, 2**d - 1

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        size = n_models * nodes * k * n_bins
        total = np.zeros((1 + len(LEVELS), size), dtype=np.int64)
        for b in batches:
            model, bins = b["model"].to_numpy(), b[names].to_numpy(dtype=np.int64)
            node = forest.node(model, bins, feature, at, d) - first
            cell = (((model * nodes + node) * k)[:, None] + np.arange(k)) * n_bins + bins
            under = b["y"].to_numpy()[:, None] < forest.quantiles(model, bins)
            total[0] += np.bincount(cell.ravel(), minlength=size)
            for q in range(len(LEVELS)):
                total[1 + q] += np.bincount(cell[under[:, q]].ravel(), minlength=size)
        full = np.flatnonzero(total[0])
        rest, bin_ = np.divmod(full, n_bins)
        rest, f = np.divmod(rest, k)
        m, node = np.divmod(rest, nodes)
        yield pd.DataFrame({"model": m, "node": node + first, "feature": f, "bin": bin_, "n": total[0, full], **{f"b{q}": total[1 + q, full] for q in range(len(LEVELS))}})

    return run


def _leftover(forest: Forest, names: list[str], feature: np.ndarray, at: np.ndarray):
    first = 2**forest.depth - 1

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            model, bins = b["model"].to_numpy(), b[names].to_numpy(dtype=np.int64)
            left = b["y"].to_numpy()[:, None] - forest.quantiles(model, bins)
            leaf = forest.node(model, bins, feature, at, forest.depth) - first
            yield pd.DataFrame({"model": model, "leaf": leaf, **{f"r{q}": left[:, q] for q in range(len(LEVELS))}})

    return run


def forecast_with(forest: Forest, model: Column, x: Column) -> Column:
    """Quantiles in rising order, as an array; null for a model without examples or features with a null."""

    @F.pandas_udf("array<double>")
    def read(model: pd.Series, x: pd.Series) -> pd.Series:
        m = model.to_numpy(dtype=np.int64)
        if not len(m):
            return pd.Series([], dtype=object)
        q = np.sort(forest.quantiles(m, forest.bins(m, np.stack(x.to_numpy()).astype(float))), axis=1)
        return pd.Series(list(q))

    usable = F.array(*[F.lit(int(i)) for i in np.flatnonzero(forest.n)]) if forest.n.any() else F.array().cast("array<int>")
    fine = F.array_contains(usable, model) & x.isNotNull() & ~F.exists(x, lambda v: v.isNull())
    width = forest.edges.shape[1]
    safe = F.when(fine, x).otherwise(F.array(*[F.lit(0.0)] * width))
    return F.when(fine, read(F.when(fine, model).otherwise(F.lit(0)).cast("int"), safe))
