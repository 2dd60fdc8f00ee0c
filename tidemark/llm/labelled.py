"""Bounded samples of labelled rows, and the small logistic fit that the classifiers share."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def remainder(divisor: int, id_col: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo ``divisor``; a null id counts as an empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % divisor


def sample_ids(labels: DataFrame, label: str, allowed: Column, per_class: int) -> DataFrame:
    """``doc_id, label``: at most ``per_class`` rows of each class, those with the smallest hashes of their ids.

    Null ids and labels are left out.  Rows of one id with both labels count as the smaller one.
    """
    rows = labels.where(allowed & F.col("doc_id").isNotNull() & F.col(label).isin(0, 1)).groupBy("doc_id").agg(F.min(label).cast("int").alias("label"))
    take = lambda k: rows.where(F.col("label") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class)
    return take(0).unionAll(take(1))


def sampled_texts(docs: DataFrame, ids: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, text, label`` of the sampled ids, which are few by :func:`sample_ids`, so documents are not shuffled."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.join(F.broadcast(ids), "doc_id")


def fit_logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float, steps: int = 60) -> np.ndarray:
    """Coefficients of a logistic regression on targets in [0, 1]; column 0 of ``x`` is the constant and not shrunk.

    Newton steps, halved until the loss falls, so the fit cannot diverge.
    """
    penalty = np.full(x.shape[1], ridge)
    penalty[0] = 1e-6
    w = np.zeros(x.shape[1])

    def loss(w: np.ndarray) -> float:
        z = x @ w
        return float((weight * (np.logaddexp(0, z) - y * z)).sum() + 0.5 * (penalty * w * w).sum())

    now = loss(w)
    for _ in range(steps):
        p = sigmoid(x @ w)
        grad = x.T @ (weight * (p - y)) + penalty * w
        hess = x.T @ (x * (weight * p * (1 - p))[:, None]) + np.diag(penalty)
        step, size = np.linalg.solve(hess, grad), 1.0
        while (new := loss(w - size * step)) > now and size > 1e-6:
            size /= 2
        if not new < now - 1e-9 * abs(now):
            break
        w, now = w - size * step, new
    return w


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))
