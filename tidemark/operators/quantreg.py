"""Quantile regression refitted at many origins at once.

The pinball loss, smoothed by a uniform kernel, is convex with a piecewise linear gradient, so Newton rounds end after a few.  As in
:mod:`tidemark.operators.logistic` examples stand in blocks of bounded size, a round turns (origin, block) pairs into
parts of loss, gradient and Hessian of every level, adds them up by origin in one shuffle and moves the levels that have
not converged.  The first round is least squares, whose shifted line starts every level; the kernel's width follows
from the residuals and the number of examples.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from tidemark.functions import scoring as sc
from tidemark.operators import asof
from tidemark.operators.logistic import BLOCK, example_blocks, meeting
from tidemark.session import settled

LEVELS = np.array(sc.QUANTILE_LEVELS)
_Z = np.array([sc.Z_SCORES[q] for q in sc.QUANTILE_LEVELS])


def smoothed_pinball(e: np.ndarray, levels: np.ndarray, h: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Loss, slope and curvature of errors ``e`` (one column per level) for a kernel of half-width ``h``."""
    inner = np.abs(e) < h
    loss = (levels - 0.5) * e + np.where(inner, e * e / (4 * h) + h / 4, np.abs(e) / 2)
    return loss, levels - 0.5 + np.clip(e / (2 * h), -0.5, 0.5), inner / (2 * h)


def parts_of(z: np.ndarray, t: np.ndarray, w: np.ndarray, h: float) -> np.ndarray:
    """Per level loss, gradient and upper half of the Hessian, as one vector."""
    loss, slope, curve = smoothed_pinball(t[:, None] - z @ w.T, LEVELS, h)
    i, j = np.triu_indices(z.shape[1])
    return np.concatenate([loss.sum(axis=0)[:, None], -slope.T @ z, curve.T @ (z[:, i] * z[:, j])], axis=1).ravel()


def square_parts(z: np.ndarray, t: np.ndarray) -> np.ndarray:
    i, j = np.triu_indices(z.shape[1])
    return np.concatenate([[t @ t], t @ z, (z[:, i] * z[:, j]).sum(axis=0)])


def full(upper: np.ndarray, d: int) -> np.ndarray:
    m = np.zeros((d, d))
    m[np.triu_indices(d)] = upper
    return m + np.triu(m, 1).T


def started(sums: np.ndarray, n: int, d: int) -> dict:
    """Least squares, every level at its normal quantile above the line."""
    beta = np.linalg.lstsq(full(sums[1 + d :], d) + 1e-9 * n * np.eye(d), sums[1 : 1 + d], rcond=None)[0]
    sd = np.sqrt(max(sums[0] - beta @ sums[1 : 1 + d], 0) / max(n - d, 1))
    w = np.tile(beta, (len(LEVELS), 1))
    w[:, 0] += _Z * sd
    # an exact fit has no spread: a narrow kernel of its own keeps the rounds defined
    h = max(sd, 1e-6) * max(0.05, ((np.log(n) + d) / n) ** 0.4)
    return {"base": w.ravel(), "step": np.zeros(w.size), "scale": np.ones(len(LEVELS)), "fall": np.zeros(len(LEVELS)), "loss": np.full(len(LEVELS), np.inf), "h": h, "done": False, "converged": False}


def moved(state: dict, sums: np.ndarray, n: int, d: int, tolerance: float) -> dict:
    """One round: a level whose loss fell takes its next Newton step, another shortens its step to the lowest point of the parabola through what is known."""
    k = len(LEVELS)
    base, step, scale, loss = np.reshape(state["base"], (k, d)).copy(), np.reshape(state["step"], (k, d)).copy(), np.array(state["scale"]), np.array(state["loss"])
    fall, sums = np.array(state["fall"]), sums.reshape(k, -1)
    for q in range(k):
        if not sums[q, 0] <= loss[q] + 1e-12 * abs(sums[q, 0]):
            lowest = fall[q] * scale[q] ** 2 / (2 * (sums[q, 0] - loss[q] + fall[q] * scale[q]))
            scale[q] = np.clip(lowest, 0.02 * scale[q], 0.5 * scale[q])
            continue
        base[q] -= scale[q] * step[q]
        hess = full(sums[q, 1 + d :], d)
        step[q] = np.linalg.solve(hess + (1e-9 * np.trace(hess) + 1e-6 * n) * np.eye(d), sums[q, 1 : 1 + d])
        scale[q], loss[q], fall[q] = 1.0, sums[q, 0], sums[q, 1 : 1 + d] @ step[q]
    moves = scale * np.abs(step).max(axis=1)
    small = bool((moves < tolerance * max(state["h"], 1e-9)).all())
    return {**state, "base": base.ravel(), "step": step.ravel(), "scale": scale, "fall": fall, "loss": loss, "done": small, "converged": small}


_STATE = "base array<double>, step array<double>, scale array<double>, fall array<double>, loss array<double>, h double, done boolean, converged boolean"
_FIXED = "_id long, series_id string, h_ahead int, n int, mean array<double>, sd array<double>"


def fit_quantiles(origins: DataFrame, examples: DataFrame, n_features: int, *, rounds: int = 25, tolerance: float = 1e-2, block: int = BLOCK) -> DataFrame:
    """``_id, quantiles, converged, n`` for every origin with more than twice as many examples as coefficients.

    ``origins``: ``_id, series_id, h_ahead, as_of, now``; ``examples``: ``series_id, h_ahead, known_at, x, y`` with
    features ``x`` (no constant).  Levels that cross are put in order.  Steps count as small below ``tolerance`` kernel widths.
    """
    keys, d, width = ["series_id", "h_ahead"], n_features + 1, n_features + 1
    # the target travels as a last feature, so that means and deviations come with those of the features
    rows = examples.select(*keys, "known_at", F.concat("x", F.array(F.col("y").cast("double"))).alias("x"), F.lit(0).alias("y"))
    rows = settled(rows, "examples")
    blocks = settled(example_blocks(rows, keys, "known_at", block), "blocks")
    asked = asof.state_at(origins, rows, keys, "as_of", F.col("known_at"), {"n": asof.count_rows()}).filter(F.col("n") > 2 * d).withColumn("n", F.col("n").cast("int"))
    asked = settled(asked, "asked")
    each = meeting(asked.select("_id", *keys, "n"), blocks, keys, width, block).select("_id", "x", F.explode(F.sequence(F.lit(0), F.size("y") - 1)).alias("j"))
    at = lambda c: F.get("x", F.col("j") * width + c)
    moments = each.groupBy("_id").agg(F.array(*[F.avg(at(c)) for c in range(width)]).alias("mean"), F.array(*[F.stddev_pop(at(c)) for c in range(width)]).alias("sd"))
    told = asked.select("_id", *keys, "n").join(moments.hint("merge"), "_id")
    told = settled(told.withColumn("sd", F.transform("sd", lambda v: F.when(v == 0, 1.0).otherwise(v))).select(*[c.split()[0] for c in _FIXED.split(", ")]), "moments")
    fixed, state = ([c.split()[0] for c in s.split(", ")] for s in (_FIXED, _STATE))

    def standard(x: np.ndarray, mean: np.ndarray, sd: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        v = (np.reshape(x, (-1, width)) - mean) / sd
        return np.column_stack([np.ones(len(v)), v[:, :-1]]), v[:, -1]

    def added(frame: DataFrame, part, size: int, columns: Sequence[str]) -> DataFrame:
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                out = [part(*standard(x, m, s), *more) for x, m, s, *more in zip(*(batch[c] for c in ("x", "mean", "sd", *columns)))]
                yield pd.DataFrame({"_id": batch["_id"], "part": out})

        sums = meeting(frame.select("_id", *keys, "n", "mean", "sd", *columns), blocks, keys, width, block).mapInPandas(run, "_id long, part array<double>")
        return sums.groupBy("_id").agg(F.array(*[F.sum(F.col("part")[i]) for i in range(size)]).alias("sums"))

    def start(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            new = [started(np.asarray(s), n, d) for s, n in zip(batch["sums"], batch["n"])]
            yield pd.concat([batch[fixed].reset_index(drop=True), pd.DataFrame(new, columns=state)], axis=1)

    def move(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            new = [moved(s, np.asarray(v), n, d, tolerance) for s, v, n in zip(batch[state].to_dict("records"), batch["sums"], batch["n"])]
            yield pd.concat([batch[fixed].reset_index(drop=True), pd.DataFrame(new, columns=state)], axis=1)

    def trial(z, t, base, step, scale, h):
        w = np.reshape(base, (len(LEVELS), d)) - np.asarray(scale)[:, None] * np.reshape(step, (len(LEVELS), d))
        return parts_of(z, t, w, h)

    upper = d * (d + 1) // 2
    schema = f"{_FIXED}, {_STATE}"
    active = settled(told.join(added(told, square_parts, 1 + d + upper, ()).hint("merge"), "_id").mapInPandas(start, schema), "rounds")
    finished = []
    for _ in range(rounds):
        if active.isEmpty():
            break
        sums = added(active, trial, len(LEVELS) * (1 + d + upper), ("base", "step", "scale", "h"))
        after = settled(active.join(sums.hint("merge"), "_id").mapInPandas(move, schema), "rounds")
        finished.append(after.filter("done"))
        active = after.filter("NOT done")
    fitted = active
    for f in finished:
        fitted = fitted.unionByName(f)

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for now, mean, sd, w in zip(*(batch[c] for c in ("now", "mean", "sd", "base"))):
                z = np.r_[1.0, (np.asarray(now) - mean[:-1]) / sd[:-1]]
                out.append(np.sort(mean[-1] + sd[-1] * (np.reshape(w, (len(LEVELS), d)) @ z)))
            yield pd.DataFrame({"_id": batch["_id"], "quantiles": out, "converged": batch["converged"], "n": batch["n"]})

    whole = fitted.join(asked.select("_id", "now").hint("merge"), "_id")
    return whole.mapInPandas(read, "_id long, quantiles array<double>, converged boolean, n int")
