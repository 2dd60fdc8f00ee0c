"""Recursive filters along series, block by block.

A filter runs once for each of several parameter sets and reports, at every step, the set that fits best so far.
Its step is affine in the state and its error too, so a block of steps is an affine map, and the squared
errors of the block are a quadratic form of the state before it.  That gives three passes, none of which
sees more than a block of raw rows at once:

1. every block is reduced to its map and form, without knowing the state before it;
2. the maps are applied in order, one row a block, which gives the state and the errors so far at each block's start;
3. every block is filtered again from its true start.

The variance of the local level does not depend on the values: its step is a ratio of linear maps, and the power of
a 2 x 2 matrix gives it at any block's start.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from tidemark.operators.ordered import row_index
from tidemark.session import settled

#: Steps in a block.
BLOCK = 512

ALPHAS = np.linspace(0.05, 0.95, 19)
RATIOS = np.logspace(-3, 2, 21)
SEASONAL_GRID = np.array([(a, b, g) for a in (0.1, 0.3, 0.6, 0.9) for b in (0.0, 0.05, 0.2) for g in (0.05, 0.2, 0.5)])


def first_least(x: np.ndarray, slack: float | np.ndarray | None = None) -> np.ndarray:
    """The first set of each row within ``slack`` (a billionth of it, if not given) of the least: early on many sets fit alike, and that must not hang on the last digit."""
    least = x.min(axis=1, keepdims=True)
    return np.argmax(x <= least + (1e-9 * least if slack is None else slack), axis=1)


class SimpleSmoothing:
    """``level += alpha * error``; state: level."""

    schema = "level double, sd double, gain double"
    size, lead = 1, 1

    def __init__(self, alphas: np.ndarray = ALPHAS) -> None:
        self.alphas, self.sets = alphas, len(alphas)

    def start(self, lead: np.ndarray) -> np.ndarray:
        return np.full((self.size, self.sets), lead[0])

    def steps(self, first: int, n: int) -> None:
        """What the steps ``first .. first + n - 1`` need beside the values."""

    def step(self, state: np.ndarray, y: np.ndarray, t: int, i: int) -> tuple[np.ndarray, np.ndarray]:
        """The state after step ``t`` (the ``i``-th prepared) and the error; a last axis may hold affine coefficients."""
        error = y - state[0]
        return (state[0] + self.alphas[:, None] * error)[None], error

    def weights(self, t: int, i: int) -> np.ndarray | float:
        return 1.0

    def log_scale(self, n: int) -> np.ndarray:
        return np.zeros((n, self.sets))

    def report(self, states: np.ndarray, sse: np.ndarray, logs: np.ndarray, t: np.ndarray) -> dict[str, np.ndarray]:
        best, rows = first_least(sse), np.arange(len(t))
        sd = np.sqrt(np.maximum(sse[rows, best], 0) / np.maximum(t - 1, 1))
        return {"level": states[rows, 0, best], "sd": sd, "gain": self.alphas[best]}


class LocalLevel(SimpleSmoothing):
    """Kalman filter of a random walk seen with noise, for each ratio of the two variances; the likeliest so far is reported."""

    schema = "level double, sd double, gain double, noise double"

    def __init__(self, ratios: np.ndarray = RATIOS) -> None:
        self.ratios, self.sets = ratios, len(ratios)

    def variance(self, n: int) -> np.ndarray:
        """Variance after ``n`` updates from one: ``(v + r) / (v + r + 1)`` is the map of ``[[1, r], [1, 1 + r]]``."""
        power = np.tile(np.eye(2), (self.sets, 1, 1))
        base = np.stack([np.ones((self.sets, 2)), np.stack([self.ratios, 1 + self.ratios], axis=1)], axis=2)
        while n:
            if n & 1:
                power = power @ base
                power /= power.max(axis=(1, 2), keepdims=True)
            base = base @ base
            base /= base.max(axis=(1, 2), keepdims=True)
            n >>= 1
        top, low = power[:, 0].sum(axis=1), power[:, 1].sum(axis=1)
        return top / low

    def steps(self, first: int, n: int) -> None:
        var = self.variance(max(first - 1, 0))
        self.gain, self.f, self.var = np.zeros((n, self.sets)), np.ones((n, self.sets)), np.empty((n, self.sets))
        for i in range(n):
            if first + i:
                prior = var + self.ratios
                self.f[i], self.gain[i] = prior + 1, prior / (prior + 1)
                var = prior / (prior + 1)
            self.var[i] = var

    def step(self, state: np.ndarray, y: np.ndarray, t: int, i: int) -> tuple[np.ndarray, np.ndarray]:
        error = y - state[0]
        return (state[0] + self.gain[i][:, None] * error)[None], error

    def weights(self, t: int, i: int) -> np.ndarray | float:
        return 1 / self.f[i]

    def log_scale(self, n: int) -> np.ndarray:
        return np.log(self.f[:n])

    def report(self, states: np.ndarray, sse: np.ndarray, logs: np.ndarray, t: np.ndarray) -> dict[str, np.ndarray]:
        steps, rows = np.maximum(t, 1)[:, None], np.arange(len(t))
        scale = np.maximum(sse / steps, 1e-300)
        best = first_least(steps * np.log(scale) + logs, 1e-9)
        noise = scale[rows, best]
        return {"level": states[rows, 0, best], "sd": np.sqrt(noise * (1 + self.var[rows, best])), "gain": self.ratios[best], "noise": noise}


class SeasonalSmoothing(SimpleSmoothing):
    """Additive trend and season over sets of (alpha, beta, gamma); state: level, trend and the season by step modulo period."""

    schema = "level double, trend double, season array<double>, sd double, a double, b double, g double"

    def __init__(self, period: int, grid: np.ndarray = SEASONAL_GRID) -> None:
        self.period, self.size, self.lead, self.sets = period, period + 2, period, len(grid)
        self.a, self.b, self.g = (grid[:, i][:, None] for i in range(3))

    def start(self, lead: np.ndarray) -> np.ndarray:
        state = np.zeros((self.size, self.sets))
        state[0] = lead.mean()
        state[2 : 2 + len(lead)] = (lead - lead.mean())[:, None]
        return state

    def step(self, state: np.ndarray, y: np.ndarray, t: int, i: int) -> tuple[np.ndarray, np.ndarray]:
        at = 2 + t % self.period
        base = state[0] + state[1]
        error = y - base - state[at]
        new = state.copy()
        new[0], new[1], new[at] = base + self.a * error, state[1] + self.a * self.b * error, state[at] + self.g * error
        return new, error

    def weights(self, t: int, i: int) -> np.ndarray | float:
        return 1.0 if t >= self.period else 0.0

    def report(self, states: np.ndarray, sse: np.ndarray, logs: np.ndarray, t: np.ndarray) -> dict[str, np.ndarray]:
        best, rows = first_least(sse), np.arange(len(t))
        season = states[rows, 2:, best]
        ahead = [np.roll(s, -((k + 1) % self.period)).tolist() for s, k in zip(season, t)]
        sd = np.sqrt(np.maximum(sse[rows, best], 0) / np.maximum(t - self.period, 1))
        return {"level": states[rows, 0, best], "trend": states[rows, 1, best], "season": ahead, "sd": sd, **{n: getattr(self, n)[best, 0] for n in "abg"}}


Filter = SimpleSmoothing


def block_map(f: Filter, y: np.ndarray, first: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Affine map ``(size, sets, size + 1)``, quadratic form ``(sets, size + 1, size + 1)`` and sum of logs of a block.

    Levels are taken relative to the block's first value, which keeps the form well conditioned.
    """
    d = f.size
    state = np.zeros((d, f.sets, d + 1))
    state[np.arange(d), :, np.arange(d)] = 1
    form, one = np.zeros((f.sets, d + 1, d + 1)), np.eye(d + 1)[d]
    f.steps(first, len(y))
    for i, value in enumerate(y - y[0]):
        state, error = f.step(state, value * one, first + i, i)
        form += (np.broadcast_to(f.weights(first + i, i), f.sets)[:, None] * error)[:, :, None] * error[:, None, :]
    return state, form, f.log_scale(len(y)).sum(axis=0)


def pass_block(state: np.ndarray, sse: np.ndarray, ref: float, move: np.ndarray, form: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """State and errors after a block, from those before it."""
    here = np.concatenate([state, np.ones((1, state.shape[1]))])
    here[0] -= ref
    after = np.einsum("dkm,mk->dk", move, here)
    after[0] += ref
    return after, sse + np.maximum(np.einsum("mk,kmn,nk->k", here, form, here), 0)


def run_block(f: Filter, y: np.ndarray, first: int, state: np.ndarray, sse: np.ndarray, logs: np.ndarray) -> dict[str, np.ndarray]:
    """Reports at every step of a block."""
    f.steps(first, len(y))
    states, errors = np.empty((len(y), f.size, f.sets)), np.empty((len(y), f.sets))
    state = state[:, :, None]
    for i, value in enumerate(y):
        state, error = f.step(state, np.array([value]), first + i, i)
        states[i], errors[i] = state[:, :, 0], f.weights(first + i, i) * error[:, 0] ** 2
    return f.report(states, sse + errors.cumsum(axis=0), logs + f.log_scale(len(y)).cumsum(axis=0), first + np.arange(len(y)))


def states_along(grid: DataFrame, f: Filter, block: int = BLOCK) -> DataFrame:
    """``series_id, at`` and the filter's report for every row of a gapless ``grid(series_id, timestamp, value)``.

    A task holds blocks of raw rows, or one row a block of a series.
    """
    block = max(block, f.lead)
    numbered = row_index(grid, ["series_id"], "timestamp", "_i").select("series_id", (F.col("_i") - 1).alias("t"), "timestamp", "value")
    row = F.struct("t", F.col("timestamp").alias("at"), F.col("value").cast("double").alias("y"))
    blocks = numbered.groupBy("series_id", F.floor(F.col("t") / block).alias("block")).agg(F.sort_array(F.collect_list(row)).alias("rows"))
    field = lambda name: F.transform("rows", lambda r: r[name]).alias(name)
    blocks = settled(blocks.select("series_id", "block", field("at"), field("y")), "filter_blocks")

    def reduce(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for s, b, y in zip(batch["series_id"], batch["block"], batch["y"]):
                y = np.asarray(y, dtype=float)
                move, form, logs = block_map(f, y, b * block)
                rows.append((s, b, y[0], y[: f.lead] if b == 0 else [], move.ravel(), form.ravel(), logs))
            yield pd.DataFrame(rows, columns=["series_id", "block", "ref", "lead", "move", "form", "logs"])

    def carry(maps: pd.DataFrame) -> pd.DataFrame:
        maps = maps.sort_values("block")
        state, sse, logs = f.start(np.asarray(maps["lead"].iloc[0], dtype=float)), np.zeros(f.sets), np.zeros(f.sets)
        rows, d = [], f.size
        for s, b, ref, move, form, more in zip(*(maps[c] for c in ("series_id", "block", "ref", "move", "form", "logs"))):
            rows.append((s, b, state.ravel(), sse, logs))
            state, sse = pass_block(state, sse, ref, np.reshape(move, (d, f.sets, d + 1)), np.reshape(form, (f.sets, d + 1, d + 1)))
            logs = logs + np.asarray(more)
        return pd.DataFrame(rows, columns=["series_id", "block", "state", "sse", "logs"])

    names = [c.split()[0] for c in f.schema.split(", ")]

    def apply(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for s, b, at, y, state, sse, logs in zip(*(batch[c] for c in ("series_id", "block", "at", "y", "state", "sse", "logs"))):
                told = run_block(f, np.asarray(y, dtype=float), b * block, np.reshape(state, (f.size, f.sets)), np.asarray(sse), np.asarray(logs))
                yield pd.DataFrame({"series_id": s, "at": at, **told})[["series_id", "at", *names]]

    numbers = "array<double>"
    maps = blocks.select("series_id", "block", "y").mapInPandas(
        reduce, f"series_id string, block long, ref double, lead {numbers}, move {numbers}, form {numbers}, logs {numbers}"
    )
    starts = maps.groupBy("series_id").applyInPandas(carry, f"series_id string, block long, state {numbers}, sse {numbers}, logs {numbers}")
    return blocks.join(starts.hint("merge"), ["series_id", "block"]).mapInPandas(apply, f"series_id string, at timestamp_ntz, {f.schema}")
