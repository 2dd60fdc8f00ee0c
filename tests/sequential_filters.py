"""The filters step by step over a whole series, to compare the blocked ones with."""

import numpy as np
import pandas as pd


def _pick_best(sse: np.ndarray) -> np.ndarray:
    return np.argmax(sse <= sse.min(axis=1, keepdims=True) * (1 + 1e-9), axis=1)


def simple_smoothing_states(y: np.ndarray, alphas: np.ndarray) -> pd.DataFrame:
    """Level, deviation and chosen alpha after each value; alpha minimises the squared errors so far."""
    levels, errors = np.empty((len(y), len(alphas))), np.zeros((len(y), len(alphas)))
    level = np.full(len(alphas), y[0])
    levels[0] = level
    for t in range(1, len(y)):
        e = y[t] - level
        level = level + alphas * e
        levels[t], errors[t] = level, e * e
    sse = errors.cumsum(axis=0)
    best, rows = _pick_best(sse), np.arange(len(y))
    dof = np.maximum(rows - 1, 1)
    return pd.DataFrame({"level": levels[rows, best], "sd": np.sqrt(sse[rows, best] / dof), "gain": alphas[best]})


def local_level_states(y: np.ndarray, ratios: np.ndarray) -> pd.DataFrame:
    """1-d Kalman filter for each signal-to-noise ratio; the likeliest so far is reported at each date."""
    n, k = len(y), len(ratios)
    mean, var = np.full(k, y[0]), np.ones(k)
    means, variances = np.empty((n, k)), np.empty((n, k))
    quad, logdet = np.zeros((n, k)), np.zeros((n, k))
    means[0], variances[0] = mean, var
    for t in range(1, n):
        prior = var + ratios
        f = prior + 1.0
        v = y[t] - mean
        gain = prior / f
        mean, var = mean + gain * v, prior * (1 - gain)
        means[t], variances[t], quad[t], logdet[t] = mean, var, v * v / f, np.log(f)
    steps = np.maximum(np.arange(n), 1)[:, None]
    scale = np.maximum(quad.cumsum(axis=0) / steps, 1e-300)
    x = steps * np.log(scale) + logdet.cumsum(axis=0)
    best = np.argmax(x <= x.min(axis=1, keepdims=True) + 1e-9, axis=1)
    rows = np.arange(n)
    noise = scale[rows, best]
    return pd.DataFrame(
        {"level": means[rows, best], "sd": np.sqrt(noise * (1.0 + variances[rows, best])), "gain": ratios[best], "noise": noise}
    )


def seasonal_smoothing_states(y: np.ndarray, period: int, grid: np.ndarray) -> pd.DataFrame:
    """Additive trend and season, vectorised over a grid of (alpha, beta, gamma)."""
    n, k = len(y), len(grid)
    a, b, g = grid[:, 0], grid[:, 1], grid[:, 2]
    lead = y[: min(period, n)]
    level, trend = np.full(k, lead.mean()), np.zeros(k)
    season = np.zeros((k, period))
    season[:, : len(lead)] = lead - lead.mean()
    keep = {name: np.empty((n, k)) for name in ("level", "trend", "sse")}
    seasons, total = np.empty((n, k, period)), np.zeros(k)
    for t in range(n):
        s = season[:, t % period].copy()
        base = level + trend
        e = y[t] - base - s
        if t >= period:
            total = total + e * e
        new_level = base + a * e
        trend = trend + a * b * e
        season[:, t % period] = s + g * e
        level = new_level
        keep["level"][t], keep["trend"][t], keep["sse"][t], seasons[t] = level, trend, total, season
    best, rows = _pick_best(keep["sse"]), np.arange(n)
    ahead = [np.roll(seasons[t, best[t]], -((t + 1) % period)) for t in rows]
    return pd.DataFrame(
        {
            "level": keep["level"][rows, best], "trend": keep["trend"][rows, best], "season": [s.tolist() for s in ahead],
            "sd": np.sqrt(keep["sse"][rows, best] / np.maximum(rows - period, 1)),
            "a": a[best], "b": b[best], "g": g[best],
        }
    )
