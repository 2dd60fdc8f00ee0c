import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from helpers import OBS, observations, price_path, ts
from tidemark.operators import features as ft


@pytest.fixture(scope="module")
def gappy(spark):
    rng = np.random.default_rng(5)
    days = pd.bdate_range("2022-01-03", periods=300)
    keep = np.sort(rng.choice(300, 240, replace=False))
    keep[0], keep[-1] = 0, 299
    rows = [("g", days[i].to_pydatetime(), float(v), days[i].to_pydatetime()) for i, v in zip(keep, rng.normal(100, 5, len(keep)).round(3))]
    return spark.createDataFrame(rows, OBS).cache()


def test_business_daily_fill(gappy):
    pdf = gappy.toPandas().set_index("timestamp")["value"].sort_index()
    want = pdf.reindex(pd.bdate_range(pdf.index.min(), pdf.index.max())).ffill()
    got = ft.business_daily_fill(gappy).toPandas().sort_values("timestamp")
    assert list(got.timestamp) == list(want.index) and np.allclose(got.value, want.values)


def test_fill_gaps_is_linear_interpolation(gappy):
    pdf = gappy.toPandas().set_index("timestamp")["value"].sort_index()
    want = pdf.reindex(pd.bdate_range(pdf.index.min(), pdf.index.max())).interpolate()
    got = ft.fill_gaps(gappy, "B").toPandas().sort_values("timestamp")
    assert np.allclose(got.value, want.values)


def test_log_return_spans_dropped_rows(spark):
    obs = observations(spark, [("a", "2024-01-01", 100, None), ("a", "2024-01-02", -5, None), ("a", "2024-01-05", 110, None)])
    rows = ft.log_returns(obs).collect()
    assert len(rows) == 1 and rows[0].value == pytest.approx(np.log(1.1)) and rows[0].released_at == ts("2024-01-08")


def test_feature_lag_moves_by_row(spark):
    obs = observations(spark, [("a", "2024-01-01", 1, None), ("a", "2024-01-05", 2, None)])
    assert [(r.timestamp, r.value, r.released_at) for r in ft.feature_lag(obs).collect()] == [(ts("2024-01-05"), 1.0, ts("2024-01-05"))]


def test_release_expansion_is_exact_by_default(spark):
    # One release on a Saturday: lost by default, carried to Monday on request.
    obs = observations(spark, [("a", "2024-01-01", 1, "2024-02-01"), ("a", "2024-02-01", 2, "2024-03-02")])
    exact = {r.timestamp: r.value for r in ft.expand_from_releases(obs, "2024-01-15", "2024-03-08").collect()}
    carried = {r.timestamp: r.value for r in ft.expand_from_releases(obs, "2024-01-15", "2024-03-08", carry_in=True).collect()}
    assert min(exact) == ts("2024-02-01") and exact[ts("2024-03-08")] == 1.0
    assert carried[ts("2024-03-01")] == 1.0 and carried[ts("2024-03-04")] == 2.0


def test_rolling_std_shift(spark):
    p = ft.percent_change(price_path(spark, list(np.random.default_rng(0).normal(0, 2, 60))), 1)
    got = ft.rolling_std(p, "return_pct", 21, "v", shift=1).toPandas().sort_values("timestamp")
    want = got.return_pct.rolling(21).std().shift(1)
    assert np.allclose(got.v.to_numpy(float), want.to_numpy(), equal_nan=True)


def test_shock_indicator_drops_first_rows(spark):
    out = ft.shock_indicator(price_path(spark, [1, -6, 2, 5.0001]), 5.0).orderBy("timestamp").collect()
    assert [r.value for r in out] == [0.0, 1.0, 0.0, 1.0]


def test_change_points(spark):
    obs = observations(spark, [("a", f"2024-01-{d:02d}", v, None) for d, v in [(1, 5), (2, 5), (3, 4.75), (4, 4.75), (5, 5)]])
    assert [(r.value, r.previous) for r in ft.change_points(obs).orderBy("timestamp").collect()] == [(4.75, 5.0), (5.0, 4.75)]


def test_canonical_drops_bad_rows(spark):
    raw = spark.createDataFrame([("a", "2024-01-01", "1.5", "2024-01-02"), ("a", "2024-01-02", "x", "2024-01-03"), ("a", None, "2", "2024-01-03"), ("a", "2024-01-04", "NaN", "2024-01-05")], "series_id string, timestamp string, value string, released_at string")
    assert [r.value for r in ft.canonical(raw).collect()] == [1.5]


def test_recipes_strict(spark, gappy):
    reg = spark.createDataFrame([("x", "g", "daily_return"), ("y", "missing", "daily_level")], "series_id string, source_id string, recipe string")
    assert {r.series_id for r in ft.build_covariates(gappy, reg).select("series_id").distinct().collect()} == {"x"}
    with pytest.raises(ValueError, match="y"):
        ft.build_covariates(gappy, reg, strict=True)


def test_conform_requires_columns(spark):
    from tidemark.schemas import OBSERVATIONS, conform

    with pytest.raises(ValueError, match="timestamp"):
        conform(spark.createDataFrame([("a", 1.0)], "series_id string, value double"), OBSERVATIONS)
    assert conform(spark.createDataFrame([("a", ts("2024-01-01"))], "series_id string, timestamp timestamp_ntz"), OBSERVATIONS).first().released_at is None


def test_log_ratio_uses_shared_days(spark):
    obs = observations(spark, [("n", "2024-01-01", 4, None), ("n", "2024-01-02", 8, None), ("d", "2024-01-01", 2, None), ("d", "2024-01-03", 1, None), ("n", "2024-01-03", 2, None)])
    pairs = spark.createDataFrame([("r", "n", "d")], "series_id string, numerator string, denominator string")
    got = {r.timestamp: r.value for r in ft.log_ratio(obs, pairs).collect()}
    assert got == {ts("2024-01-02"): pytest.approx(np.log(2)), ts("2024-01-03"): pytest.approx(np.log(2))}
