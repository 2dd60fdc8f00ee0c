"""Expanding percentiles by value ranges against a sort of every prefix."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest

from tidemark.operators.ordered import exact_percentiles, expanding_percentiles


@pytest.mark.parametrize(("width", "span"), [(256, 64), (5, 3), (1, 1)])
def test_every_prefix(spark, width, span):
    """Ties, a constant series, nulls and NaN, one value and no value, whatever the sizes of ranges and spans."""
    rng = np.random.default_rng(width)
    n = 150 if width > 1 else 40
    data = {"noise": rng.normal(size=n), "ties": rng.integers(0, 4, n).astype(float), "rising": np.arange(n, dtype=float), "falling": -np.arange(n, dtype=float), "flat": np.full(n, 2.0), "one": np.array([3.0]), "none": np.array([np.nan, np.nan])}
    data["noise"][[0, 5, 17]] = np.nan
    start = dt.datetime(2020, 1, 1)
    rows = [(s, start + dt.timedelta(days=i), None if np.isnan(v) and i % 2 else float(v)) for s, y in data.items() for i, v in enumerate(y)]
    df = spark.createDataFrame(rows, "s string, t timestamp_ntz, v double").repartition(3)
    got = expanding_percentiles(df, ["s"], "t", "v", {"a": 0.33, "b": 0.67, "c": 1.0}, min_history=3, width=width, span=span).toPandas().sort_values(["s", "t"])
    for s, y in data.items():
        values = pd.Series(y).dropna()
        mine = got[got["s"] == s]
        for column, q in (("a", 0.33), ("b", 0.67), ("c", 1.0)):
            want = values.expanding(3).quantile(q).dropna()
            assert np.allclose(mine[column], want, atol=1e-12) and len(mine) == len(want), (s, column)
        assert mine["t"].tolist() == [start + dt.timedelta(days=int(i)) for i in values.index[2:]]


def test_value_ranges_are_computed_once(spark, capsys):
    """What a sketch gives depends on the order its parts arrive in, so counts and carried totals must not each compute their own edges."""
    x = np.random.default_rng(4).normal(size=600)
    df = spark.createDataFrame([("k", float(v)) for v in x], "k string, v double").repartition(4)
    out = exact_percentiles(df, ["k"], "v", {"a": 0.05, "b": 0.5, "c": 0.95})
    out.explain()
    assert "percentile_approx" not in capsys.readouterr().out
    assert [(r.a, r.b, r.c) for r in out.collect()] == [pytest.approx(tuple(np.quantile(x, [0.05, 0.5, 0.95])))]
