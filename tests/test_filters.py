"""Blocked filters against the same filters run step by step over whole series."""

import datetime as dt

import numpy as np
import pytest

import sequential_filters as sf
from tidemark.operators import filters

CASES = {
    "simple": (filters.SimpleSmoothing(), lambda y: sf.simple_smoothing_states(y, filters.ALPHAS)),
    "level": (filters.LocalLevel(), lambda y: sf.local_level_states(y, filters.RATIOS)),
    "seasonal": (filters.SeasonalSmoothing(5), lambda y: sf.seasonal_smoothing_states(y, 5, filters.SEASONAL_GRID)),
}


def series(kind, n, seed):
    rng = np.random.default_rng(seed)
    if kind == "walk":
        return 50_000 + rng.normal(0, 3, n).cumsum()
    if kind == "noise":
        return rng.normal(0, 1, n)
    return 100 + 10 * np.sin(np.arange(n) * 2 * np.pi / 5) + rng.normal(0, 1, n)


@pytest.mark.parametrize("name", CASES)
@pytest.mark.parametrize("block", [7, 50, 10_000])
def test_blocks_do_not_show(spark, name, block):
    """Equal to one pass over the whole series, whatever the blocks; one value, short and constant series included."""
    made, whole = CASES[name]
    data = {f"{kind}{n}": series(kind, n, n) for kind in ("walk", "noise", "season") for n in (1, 3, 8, 333)} | {"flat": np.full(40, 7.0)}
    start = dt.datetime(2020, 1, 1)
    rows = [(s, start + dt.timedelta(days=i), float(v)) for s, y in data.items() for i, v in enumerate(y)]
    grid = spark.createDataFrame(rows, "series_id string, timestamp timestamp_ntz, value double").repartition(5)
    got = filters.states_along(grid, made, block).toPandas().sort_values(["series_id", "at"])
    assert len(got) == len(rows)
    for s, y in data.items():
        want, mine = whole(y), got[got["series_id"] == s]
        for column in want.columns:
            a, b = (np.array(x[column].tolist(), dtype=float) for x in (want, mine))
            assert np.allclose(a, b, rtol=1e-7, atol=1e-7 * max(1, abs(y).max())), (s, column)


def test_variance_of_a_block_start_is_the_recursion():
    f, var = filters.LocalLevel(), np.ones(len(filters.RATIOS))
    for n in range(1, 400):
        var = (var + filters.RATIOS) / (var + filters.RATIOS + 1)
        assert np.allclose(f.variance(n), var, rtol=1e-10)
