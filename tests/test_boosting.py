"""Boosted quantile trees at many refits against one training set at a time."""

import datetime as dt
import json

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from helpers import OBS
from sequential_boosting import LEVELS, boosted
from test_forecast import task_and_spec
from tidemark.operators import boosting, forecast as fc
from tidemark.plans import backtest as bt


def table(spark, model, x, y):
    return spark.createDataFrame([(int(m), [float(v) for v in r], float(t)) for m, r, t in zip(model, x, y)], "model int, x array<double>, y double")


def read(spark, forest, model, x):
    asked = spark.createDataFrame([(i, int(m), r) for i, (m, r) in enumerate(zip(model, x))], "i int, model int, x array<double>")
    return [r.q for r in asked.select("i", boosting.forecast_with(forest, F.col("model"), F.col("x")).alias("q")).orderBy("i").collect()]


@pytest.fixture(scope="module")
def drawn():
    """Spread follows one feature, level another; a third is noise; the second model has a few ties."""
    rng = np.random.default_rng(3)
    x = rng.uniform(0, 1, (900, 3))
    y = np.where(x[:, 0] > 0.5, 3.0, 0.0) + rng.normal(size=900) * (0.2 + 2 * (x[:, 1] > 0.6))
    model = np.repeat([0, 1], [600, 300])
    y[model == 1] = np.round(y[model == 1])
    return model, x, y


def test_as_one_training_set_at_a_time(spark, drawn):
    model, x, y = drawn
    forest = boosting.fit_forest(table(spark, model, x, y).repartition(5), 3, 3, n_trees=4)
    now = np.random.default_rng(4).uniform(0, 1, (40, 3))
    for m in (0, 1):
        got = np.array(read(spark, forest, [m] * 40, now.tolist()))
        assert np.allclose(got, boosted(x[model == m], y[model == m], now, 4), rtol=0, atol=1e-12)
    # a model without examples and features with a gap have no forecast
    assert read(spark, forest, [2, 0], [[0.1, 0.2, 0.3], [0.1, None, 0.3]]) == [None, None]
    assert list(forest.n) == [600, 300, 0]


def test_finds_level_and_spread(spark, drawn):
    model, x, y = drawn
    one = model == 0
    forest = boosting.fit_forest(table(spark, model[one], x[one], y[one]), 1, 3, n_trees=10, rate=0.5)
    low, high, wide = np.array(read(spark, forest, [0, 0, 0], [[0.2, 0.3, 0.5], [0.8, 0.3, 0.5], [0.2, 0.8, 0.5]]))
    assert abs(low[5]) < 0.3 and abs(high[5] - 3) < 0.3 and wide[9] - wide[1] > 2 * (low[9] - low[1])


def test_no_examples_and_one_repeated_example(spark):
    empty = boosting.fit_forest(table(spark, [], [], []), 1, 2, n_trees=1)
    assert read(spark, empty, [0], [[1.0, 2.0]]) == [None]
    same = boosting.fit_forest(table(spark, [0] * 50, [[1.0, 2.0]] * 50, [7.0] * 50), 1, 2, n_trees=2)
    assert read(spark, same, [0], [[5.0, -1.0]]) == [[7.0] * 11]


def _series(seed, name, n=500):
    rng = np.random.default_rng(seed)
    days, v = pd.date_range("2020-01-01", periods=n), [20.0]
    for _ in range(n - 1):
        v.append(20 + 0.6 * (v[-1] - 20) + rng.normal())
    return [(name, d.to_pydatetime(), float(a), (d + pd.Timedelta(days=2)).to_pydatetime()) for d, a in zip(days, v)]


def test_every_origin_from_what_its_refit_knew(spark):
    rows = _series(1, "w") + _series(2, "z")
    dates = [d.strftime("%Y-%m-%d") for d in pd.date_range("2020-04-01", "2021-04-20", freq="20D")]
    t, s = task_and_spec(spark, "w", "D", (1, 3), dates=dates, start="2020-01-01", end="2022-01-01")
    refits = [dt.datetime(2020, 4, 1), dt.datetime(2020, 11, 1)]

    def run(rows, **kw):
        obs = spark.createDataFrame(rows, OBS)
        return fc.boosted_regression(fc.context(bt.origin_table(t, s), obs), obs, (1, 3), 3, n_trees=3, **kw).orderBy("as_of", "horizon").collect()

    got = run(rows, refits=refits)
    assert len(got) == 2 * len(dates)
    by = {n: [r for r in rows if r[0] == n] for n in "wz"}

    def features(series, i):
        v, size = series[i][2], abs(series[i][2])
        return [(series[i - 1][2] - v) / size, (series[i - 2][2] - v) / size, float(series[i][1].month)]

    for r in got[::5]:
        cut = max(c for c in refits if c <= r.as_of)
        x, y = [], []
        for series in by.values():
            seen = [o for o in series if o[3] <= cut]
            for i in range(2, len(seen) - r.horizon):
                x.append(features(seen, i))
                y.append((seen[i + r.horizon][2] - seen[i][2]) / abs(seen[i][2]))
        last = max(i for i, o in enumerate(by["w"]) if o[3] <= r.as_of)
        v = by["w"][last][2]
        want = v + abs(v) * boosted(np.array(x), np.array(y), np.array([features(by["w"], last)]), 3)[0]
        assert np.allclose([q.v for q in r.quantiles], want, atol=1e-9)
        assert json.loads(r.metadata) == {"refit": str(cut), "n_train": len(y)}

    # what is released later does not reach a forecast, whatever it holds
    edge = dt.datetime(2021, 1, 1)
    changed = [(n, d, v if rel <= edge else v * 9, rel) for n, d, v, rel in rows]
    early = lambda rs: [(r.as_of, r.horizon, [q.v for q in r.quantiles]) for r in rs if r.as_of <= edge]
    assert early(run(changed)) == early(run(rows))
    # by default the first origin is a refit date, so that no origin is left out
    assert len(run(rows)) == 2 * len(dates)


def test_values_of_any_sign_and_late_releases(spark):
    rows = [(n, d, v - 20, rel if d.day % 9 else rel + dt.timedelta(days=30)) for n, d, v, rel in _series(5, "w", 300)]
    rows[150] = (*rows[150][:2], 0.0, rows[150][3])
    t, s = task_and_spec(spark, "w", "D", (2,), dates=["2020-06-01", "2020-08-03", "2020-09-09"], start="2020-01-01", end="2022-01-01")
    obs = spark.createDataFrame(rows, OBS)
    got = fc.boosted_regression(fc.context(bt.origin_table(t, s), obs), obs, (2,), 3, n_trees=2).collect()
    assert len(got) == 3 and all(a.v <= b.v for r in got for a, b in zip(r.quantiles, r.quantiles[1:]))


def test_no_origins(spark):
    obs = spark.createDataFrame(_series(1, "w", 30), OBS)
    t, s = task_and_spec(spark, "w", "D", (1,), dates=["2020-01-20"], start="2020-01-01", end="2022-01-01")
    ctx = fc.context(bt.origin_table(t, s), obs)
    assert fc.boosted_regression(ctx.filter("1 = 0"), obs, (1,)).count() == 0
