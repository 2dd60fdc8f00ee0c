"""Quantile regression at many origins against one fit at a time, and its pinball loss against Gaussian bands."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from helpers import OBS, ts
from test_forecast import task_and_spec
from tidemark.functions import scoring as sc
from tidemark.operators import forecast as fc, quantreg as qr
from tidemark.plans import backtest as bt

LEVELS = np.array(sc.QUANTILE_LEVELS)


def alone(x, y, now, tolerance=1e-2):
    """The same rounds on one training set held whole."""
    n, d = len(y), x.shape[1] + 1
    both = np.column_stack([x, y])
    mean, sd = both.mean(axis=0), both.std(axis=0)
    v = (both - mean) / np.where(sd == 0, 1, sd)
    z, t = np.column_stack([np.ones(n), v[:, :-1]]), v[:, -1]
    state = qr.started(qr.square_parts(z, t), n, d)
    for _ in range(25):
        w = state["base"].reshape(11, d) - state["scale"][:, None] * state["step"].reshape(11, d)
        state = qr.moved(state, qr.parts_of(z, t, w, state["h"]), n, d, tolerance)
        if state["done"]:
            break
    return np.sort(mean[-1] + sd[-1] * (state["base"].reshape(11, d) @ np.r_[1, (now - mean[:-1]) / sd[:-1]]))


@pytest.fixture(scope="module")
def skewed(spark):
    """A series whose errors are skewed and wider where the level is high."""
    rng = np.random.default_rng(5)
    days, y = pd.bdate_range("2020-01-06", periods=700), [10.0]
    for _ in range(699):
        y.append(5 + 0.5 * y[-1] + 0.3 * y[-1] * (rng.exponential() - 0.3))
    rows = [("w", d.to_pydatetime(), float(v), (d + pd.Timedelta(days=2)).to_pydatetime()) for d, v in zip(days, y)]
    return spark.createDataFrame(rows, OBS).cache()


def test_as_one_fit_at_a_time_and_better_than_bands(spark, skewed):
    dates = [d.strftime("%Y-%m-%d") for d in pd.bdate_range("2021-02-01", "2022-08-01", freq="10B")]
    t, s = task_and_spec(spark, "w", "B", (1, 2), dates=dates, start="2020-01-01", end="2023-01-01")
    ctx = fc.context(bt.origin_table(t, s), skewed)
    got = fc.quantile_regression(ctx, skewed, (1, 2), 2).collect()
    pdf = skewed.toPandas().sort_values("timestamp").reset_index(drop=True)
    v, rel = pdf.value.to_numpy(), pdf.released_at
    assert len(got) == 2 * len(dates)
    for r in got[:: len(got) // 12]:
        train = [i for i in range(1, len(v) - r.horizon) if rel[i + r.horizon] <= r.as_of]
        x, y = np.array([[v[i], v[i - 1]] for i in train]), np.array([v[i + r.horizon] for i in train])
        last = max(i for i in range(1, len(v)) if rel[i] <= r.as_of)
        assert np.allclose([q.v for q in r.quantiles], alone(x, y, np.array([v[last], v[last - 1]])), rtol=1e-6)
    assert all(r.metadata is None for r in got)

    def judged(rows):
        loss, inside = [], []
        for r in rows:
            last = max(i for i in range(len(v)) if rel[i] <= r.as_of)
            e = v[last + r.horizon] - np.array([q.v for q in r.quantiles])
            loss.append(np.maximum(LEVELS * e, (LEVELS - 1) * e).mean())
            inside.append(e[1] >= 0 >= e[9])
        return np.mean(loss), np.mean(inside)

    (mine, covered), (bands, _) = judged(got), judged(fc.lagged_regression(ctx, skewed, (1, 2), 2).collect())
    assert mine < bands and 0.7 <= covered <= 0.9


def test_smoothed_loss_nears_the_pinball_loss():
    e = np.linspace(-3, 3, 601)[:, None]
    for h in (0.5, 0.01):
        loss, slope, _ = qr.smoothed_pinball(e, LEVELS, h)
        assert np.abs(loss - np.maximum(LEVELS * e, (LEVELS - 1) * e)).max() <= h / 4 + 1e-12
        assert np.allclose(np.gradient(loss, 0.01, axis=0)[1:-1], slope[1:-1], atol=0.3 if h < 0.1 else 0.02)


def test_covariates_are_read_at_their_own_release(spark):
    rows = [("y", ts("2024-01-01"), 1.0, ts("2024-01-03")), ("y", ts("2024-01-02"), 2.0, ts("2024-01-04")), ("y", ts("2024-01-05"), 3.0, None)]
    cov = [("c", ts("2024-01-01"), 10.0, ts("2024-01-04")), ("c", ts("2024-01-02"), 20.0, ts("2024-01-09")), ("d", ts("2024-01-01"), 7.0, None)]
    got = fc.known_covariates(spark.createDataFrame(rows, OBS), spark.createDataFrame(cov, OBS), ["c", "d"])
    assert sorted((r.timestamp.day, r.c, r.d) for r in got.collect()) == [(1, None, 7.0), (2, 10.0, 7.0), (5, 10.0, 7.0)]


def test_a_covariate_that_drives_the_target_is_used(spark):
    rng = np.random.default_rng(6)
    days = pd.date_range("2021-01-01", periods=400)
    c = rng.normal(size=400)
    y = np.r_[0.0, 3 * c[:-1]] + rng.normal(0, 0.1, 400)
    stamp = [d.to_pydatetime() for d in days]
    obs = spark.createDataFrame([("w", d, float(v), d) for d, v in zip(stamp, y)], OBS)
    cov = fc.known_covariates(obs, spark.createDataFrame([("c", d, float(v), d) for d, v in zip(stamp, c)], OBS), ["c"])
    t, s = task_and_spec(spark, "w", "D", (1,), dates=["2021-12-01", "2022-01-10"], start="2021-01-01", end="2023-01-01")
    for r in fc.quantile_regression(fc.context(bt.origin_table(t, s), obs), obs, (1,), 1, cov).collect():
        at = (r.as_of - dt.datetime(2021, 1, 1)).days
        assert abs(r.point - 3 * c[at]) < 0.2 and r.quantiles[9].v - r.quantiles[1].v < 0.5
