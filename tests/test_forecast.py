import math

import numpy as np
import pandas as pd
import pytest
from py4j.protocol import Py4JError
from pyspark.sql import functions as F

import sequential_filters as sf
from sequential_fits import _softmax, softmax_fit
from helpers import OBS, observations, ts
from tidemark.functions import calendar as cal, scoring as sc
from tidemark.operators import filters, forecast as fc
from tidemark.plans import backtest as bt


def monthly_ramp(spark, n=313):
    months = pd.date_range("2000-01-01", periods=n, freq="MS")
    return spark.createDataFrame([("ramp", m.to_pydatetime(), float(i), None) for i, m in enumerate(months)], OBS)


def task_and_spec(spark, series, frequency="MS", horizons=(1,), payload="continuous", start="2010-01-01", end="2012-01-01", stride=6, warmup=0, max_runs=None, dates=None):
    t = spark.range(1).select(
        F.lit("t_" + series).alias("task_id"), F.lit(series).alias("target_series_id"), F.array(*[F.lit(h) for h in horizons]).alias("horizons"),
        F.lit(frequency).alias("frequency"), F.lit(payload).alias("payload_type"), F.lit(None).cast("array<struct<label:string,value:double>>").alias("categories"),
    )
    when = F.array(*[cal.ntz(d) for d in dates]) if dates else F.lit(None).cast("array<timestamp_ntz>")
    s = t.select(
        F.lit("spec").alias("spec_id"), "task_id", cal.ntz(start).alias("start"), cal.ntz(end).alias("end"), F.lit(stride).alias("stride"),
        F.lit(warmup).alias("warmup"), F.lit(max_runs).cast("int").alias("max_runs"), when.alias("origin_dates"),
    )
    return t, s


@pytest.fixture(scope="module")
def walk(spark):
    rng = np.random.default_rng(7)
    days = pd.bdate_range("2021-01-04", periods=420)
    keep = np.sort(rng.choice(420, 380, replace=False))
    values = np.exp(np.cumsum(rng.normal(0.001, 0.02, 420))) * 50
    rows = [("w", days[i].to_pydatetime(), float(values[i]), (days[i] + pd.Timedelta(days=3)).to_pydatetime()) for i in keep]
    return spark.createDataFrame(rows, OBS).cache()


def test_ramp_backtest(spark):
    """A monthly ramp: the naive forecast one month ahead is always off by one."""
    obs = monthly_ramp(spark)
    t, s = task_and_spec(spark, "ramp")
    rows = bt.backtest(obs, t, s, {"n": fc.last_value}).orderBy("as_of").collect()
    assert [r.as_of for r in rows] == [ts(f"{y}-{m}-01") for y, m in [(2010, "01"), (2010, "07"), (2011, "01"), (2011, "07"), (2012, "01")]]
    assert all(r.score == pytest.approx(1.0) and r.metric == "crps" for r in rows)
    summary = bt.summarise(bt.backtest(obs, t, s, {"n": fc.last_value}), bt.origin_table(t, s)).first()
    assert (summary.mean_score, summary.n_scored, summary.n_skipped_origins) == (pytest.approx(1.0), 5, 0)


def test_warmup_and_unresolved_origins_are_skipped(spark):
    obs = monthly_ramp(spark, 130)  # ends 2010-10
    t, s = task_and_spec(spark, "ramp", warmup=125)
    scored = bt.backtest(obs, t, s, {"n": fc.last_value})
    row = bt.summarise(scored, bt.origin_table(t, s)).first()
    assert (row.n_scored, row.n_skipped_origins) == (1, 4)
    bt.require_scored(bt.summarise(scored, bt.origin_table(t, s)), bt.origin_table(t, s), ["last_value_naive"])
    _, never = task_and_spec(spark, "ramp", warmup=1000)
    o = bt.origin_table(t, never)
    with pytest.raises(RuntimeError, match="skipped"):
        bt.require_scored(bt.summarise(bt.backtest(obs, t, never, {"n": fc.last_value}), o), o, ["last_value_naive"])


def test_historical_frequency_of_events(spark):
    months = pd.date_range("2015-01-01", periods=120, freq="MS")
    obs = spark.createDataFrame([("e", m.to_pydatetime(), float(i % 4 == 0), None) for i, m in enumerate(months)], OBS)
    t, s = task_and_spec(spark, "e", payload="binary", dates=["2019-01-01", "2020-05-01"])
    got = {r.as_of: r.probability for r in fc.historical_frequency(fc.context(bt.origin_table(t, s), obs), obs).collect()}
    for o, p in got.items():
        seen = [float(i % 4 == 0) for i, m in enumerate(months) if m <= pd.Timestamp(o)]
        assert p == pytest.approx(np.mean(seen))
    last4 = fc.historical_frequency(fc.context(bt.origin_table(t, s), obs), obs, 4).collect()
    assert len(last4) == 2 and all(r.probability == 0.25 for r in last4)


def test_random_walk_matches_refit_on_filled_history(spark, walk):
    t, s = task_and_spec(spark, "w", "B", (1, 5), dates=["2021-06-01", "2022-03-15"], start="2021-01-01", end="2023-01-01")
    rows = fc.log_random_walk(fc.context(bt.origin_table(t, s), walk), walk).collect()
    pdf = walk.toPandas().set_index("timestamp").sort_index()
    assert len(rows) == 4
    for r in rows:
        seen = pdf[pdf.released_at <= r.as_of].value
        full = np.log(seen.reindex(pd.bdate_range(seen.index[0], seen.index[-1])).ffill().to_numpy())
        ret = np.diff(full)
        mu, sd = ret.mean(), ret.std(ddof=1)
        assert r.point == pytest.approx(math.exp(full[-1] + r.horizon * mu))
        q90 = next(x.v for x in r.quantiles if x.q == 0.9)
        assert q90 == pytest.approx(math.exp(full[-1] + r.horizon * mu + sc.Z_SCORES[0.9] * sd * math.sqrt(r.horizon)))


def test_smoothing_states_are_prefix_fits():
    y = np.random.default_rng(2).normal(10, 2, 60)
    whole = sf.simple_smoothing_states(y, filters.ALPHAS)
    for n in (5, 30, 60):
        part = sf.simple_smoothing_states(y[:n], filters.ALPHAS)
        assert np.allclose(part.to_numpy(), whole.iloc[:n].to_numpy())
    for n in (25, 50):
        a, b = sf.seasonal_smoothing_states(y[:n], 5, filters.SEASONAL_GRID), sf.seasonal_smoothing_states(y, 5, filters.SEASONAL_GRID)
        assert np.allclose(a["level"], b["level"][:n]) and np.allclose(a["sd"], b["sd"][:n])
        assert np.allclose(sf.local_level_states(y[:n], filters.RATIOS)["level"], sf.local_level_states(y, filters.RATIOS)["level"][:n])


def test_smoothing_follows_a_season():
    y = np.tile([1.0, 2.0, 3.0, 4.0, 5.0], 30)
    st = sf.seasonal_smoothing_states(y, 5, filters.SEASONAL_GRID).iloc[-1]
    ahead = [st.level + (h + 1) * st.trend + st.season[h] for h in range(5)]
    assert np.allclose(ahead, [1, 2, 3, 4, 5], atol=0.3)


@pytest.mark.parametrize("make", [lambda c, o: fc.exponential_smoothing(c, o, "B"), lambda c, o: fc.exponential_smoothing(c, o, "B", 5), lambda c, o: fc.kalman_local_level(c, o, "B")])
def test_filters_do_not_look_ahead(walk, spark, make):
    t, s = task_and_spec(spark, "w", "B", (1, 5), dates=["2021-12-01", "2022-02-01"], start="2021-01-01", end="2023-01-01")
    o = bt.origin_table(t, s)
    cut = ts("2022-02-01")
    poisoned = walk.withColumn("value", F.when(F.col("released_at") > cut, F.lit(1e9)).otherwise(F.col("value")))
    a = {(r.as_of, r.horizon): r.point for r in make(fc.context(o, walk), walk).collect()}
    b = {(r.as_of, r.horizon): r.point for r in make(fc.context(o, poisoned), poisoned).collect()}
    assert len(a) == 4 and a == pytest.approx(b)


EVERY = {
    "random_walk": fc.log_random_walk,
    "smoothing": lambda c, o: fc.exponential_smoothing(c, o, "B"),
    "seasonal": lambda c, o: fc.exponential_smoothing(c, o, "B", 5),
    "kalman": lambda c, o: fc.kalman_local_level(c, o, "B"),
    "regression": lambda c, o: fc.lagged_regression(c, o, (1, 5), 3),
    "range": lambda c, o: fc.horizons_of(fc.visible_range(c, o, 60)).withColumn("point", F.col("high") - F.col("low")),
}


@pytest.mark.parametrize("name", EVERY)
def test_rows_released_late_between_visible_rows_change_nothing(walk, spark, name):
    """Some rows are published after the origin though later stamps are visible: forecasts equal those on the visible rows alone."""
    dates = ["2021-12-01", "2022-02-01"]
    t, s = task_and_spec(spark, "w", "B", (1, 5), dates=dates, start="2021-01-01", end="2023-01-01")
    o = bt.origin_table(t, s)
    late = F.dayofmonth("timestamp") % 9 == 4
    held = walk.withColumn("released_at", F.when(late, ts("2022-12-01")).otherwise(F.col("released_at"))).cache()
    poisoned = held.withColumn("value", F.when(F.col("released_at") > ts("2022-02-01"), F.lit(1e9)).otherwise(F.col("value")))
    read = lambda obs: {(r.series_id, r.as_of, r.horizon): r.point for r in EVERY[name](fc.context(o, obs), obs).collect()}
    a = read(poisoned)
    assert len(a) == 4 and a == pytest.approx(read(held.filter(~late)))


def test_origins_off_the_grid_are_forecast(spark):
    """Monthly stamps in mid-month are off a month-start grid: the state of the newest grid step serves."""
    on = [("g", f"2020-{m:02d}-01", float(m), None) for m in range(1, 9)]
    obs = observations(spark, [*on, ("g", "2020-08-15", 100.0, None)])
    t, s = task_and_spec(spark, "g", "MS", (1,), dates=["2020-08-20"], start="2020-01-01", end="2021-01-01")
    rows = fc.exponential_smoothing(fc.context(bt.origin_table(t, s), obs), obs, "MS").collect()
    assert len(rows) == 1 and 1.0 < rows[0].point <= 8.0


def test_lagged_regression_is_least_squares_at_each_origin(spark, walk):
    t, s = task_and_spec(spark, "w", "B", (2,), dates=["2021-09-01", "2022-05-02"], start="2021-01-01", end="2023-01-01")
    rows = fc.lagged_regression(fc.context(bt.origin_table(t, s), walk), walk, (2,), 3).collect()
    pdf = walk.toPandas().sort_values("timestamp").reset_index(drop=True)
    v, rel = pdf.value.to_numpy(), pdf.released_at
    assert len(rows) == 2
    for r in rows:
        train = [i for i in range(2, len(v) - 2) if rel[i + 2] <= r.as_of]
        x = np.array([[1, v[i], v[i - 1], v[i - 2]] for i in train])
        beta, *_ = np.linalg.lstsq(x, np.array([v[i + 2] for i in train]), rcond=None)
        last = max(i for i in range(2, len(v)) if rel[i] <= r.as_of)
        assert r.point == pytest.approx(float(np.array([1, v[last], v[last - 1], v[last - 2]]) @ beta), rel=1e-6)


def test_softmax_fit_reaches_the_optimum():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(80, 2))
    for k in (2, 3):
        y = np.clip((x[:, 0] + rng.normal(0, 0.7, 80) > 0).astype(int) + (k == 3) * (x[:, 1] > 0.5), 0, k - 1)
        w = softmax_fit(x, y, k)
        z = np.column_stack([np.ones(80), x])
        p = _softmax(z @ w.T)
        target = (y[:, None] == (np.array([1]) if k == 2 else np.arange(k))).astype(float)
        grad = (p - target).T @ z + np.column_stack([np.zeros(len(w)), w[:, 1:]])
        assert np.abs(grad).max() < 1e-6


def test_classifier_falls_back_and_ignores_the_future(spark):
    rng = np.random.default_rng(4)
    days = pd.date_range("2000-01-01", periods=40, freq="30D")
    x = rng.normal(size=40)
    y = (x + rng.normal(0, 0.5, 40) > 0).astype(float)
    rows = [("s", d.to_pydatetime(), (d + pd.Timedelta(days=7)).to_pydatetime(), float(a), float(b)) for d, a, b in zip(days, x, y)]
    df = spark.createDataFrame(rows, "series_id string, as_of timestamp_ntz, known_at timestamp_ntz, f double, outcome double")
    fit = lambda d: {r.as_of: r for r in fc.fit_at_origins(d.select("series_id", "as_of", "f"), d, ["f"], [0.0, 1.0]).collect()}
    base = fit(df)
    first, last = base[days[3].to_pydatetime()], base[days[39].to_pydatetime()]
    assert first.model == "frequency_fallback" and first.class_probs[1] == pytest.approx(y[:3].mean())
    assert last.model == "logistic" and last.n_train == 39 and sum(last.class_probs) == pytest.approx(1)
    cut = days[30].to_pydatetime()
    changed = fit(df.withColumn("outcome", F.when(F.col("known_at") > cut, 1 - F.col("outcome")).otherwise(F.col("outcome"))))
    assert changed[cut].class_probs == pytest.approx(base[cut].class_probs)


@pytest.mark.parametrize(("block", "kinds"), [(5, 3), (256, 2)])
def test_batched_rounds_reach_the_fit_of_each_origin(spark, block, kinds):
    """As one fit per origin on its own examples, in blocks of any size, with absent classes, missing values and ties of release."""
    rng = np.random.default_rng(kinds)
    days = pd.date_range("2000-01-01", periods=90, freq="10D")
    frames = []
    for s in ("a", "b"):
        x = rng.normal(5_000 if s == "b" else 0, 1, (90, 2))
        y = np.clip(np.round((x[:, 0] - x[:, 0].mean()) + rng.normal(0, 0.7, 90)), 0, kinds - 1)
        y[:30] = np.minimum(y[:30], 1)  # the third class comes late
        frames.append(pd.DataFrame({"series_id": s, "as_of": days, "known_at": (days + pd.Timedelta(days=15)).floor("20D"), "f": x[:, 0], "g": x[:, 1], "outcome": y}))
    df = pd.concat(frames)
    df.loc[df.index == 7, "g"] = np.nan
    schema = "series_id string, as_of timestamp_ntz, known_at timestamp_ntz, f double, g double, outcome double"
    rows = [(r[0], r[1].to_pydatetime(), r[2].to_pydatetime(), *(None if np.isnan(v) else v for v in r[3:])) for r in df.itertuples(index=False)]
    data = spark.createDataFrame(rows, schema).repartition(3)
    got = {(r.series_id, r.as_of): r for r in fc.fit_at_origins(data.select("series_id", "as_of", "f", "g"), data, ["f", "g"], [float(i) for i in range(kinds)], block=block).collect()}
    assert len(got) == len(df)
    n_logistic = 0
    for o in df.itertuples():
        done = df[(df["series_id"] == o.series_id) & (df["known_at"] <= o.as_of)].dropna()
        r = got[o.series_id, o.as_of.to_pydatetime()]
        assert r.n_train == len(done)
        y = done["outcome"].to_numpy()
        present = np.unique(y)
        if len(done) < 16 or len(present) < 2 or np.isnan(o.g):
            assert r.model == "frequency_fallback" and r.converged is None
            continue
        n_logistic += 1
        x = done[["f", "g"]].to_numpy()
        mean, sd = x.mean(axis=0), x.std(axis=0)
        w = softmax_fit((x - mean) / sd, np.searchsorted(present, y), len(present))
        p = _softmax(np.r_[1.0, (np.array([o.f, o.g]) - mean) / sd][None, :] @ w.T)[0]
        want = np.zeros(kinds)
        want[present.astype(int)] = [1 - p[0], p[0]] if len(present) == 2 else p
        assert r.converged and np.allclose(r.class_probs, want, atol=1e-7)
    assert n_logistic > 100


def test_rounds_that_are_not_enough_are_told(spark):
    days = pd.date_range("2000-01-01", periods=40, freq="30D")
    rows = [("s", d.to_pydatetime(), d.to_pydatetime(), float(i % 7), float(i % 3 == 0)) for i, d in enumerate(days)]
    df = spark.createDataFrame(rows, "series_id string, as_of timestamp_ntz, known_at timestamp_ntz, f double, outcome double")
    got = fc.fit_at_origins(df.select("series_id", "as_of", "f"), df, ["f"], [0.0, 1.0], rounds=2).collect()
    assert {r.converged for r in got if r.model == "logistic"} == {False}


def test_macro_features_known_and_leak_safe(spark):
    origin = ts("2024-01-15")
    daily = lambda v, s: [(s, d.strftime("%Y-%m-%d"), v, None) for d in pd.date_range("2021-01-01", "2024-03-01")]
    months = pd.date_range("2021-01-01", "2024-03-01", freq="MS")
    cpi = [("c", m.strftime("%Y-%m-%d"), 100 * 1.02 ** (i / 12), None) for i, m in enumerate(months)]
    un = [("u", m.strftime("%Y-%m-%d"), 6.0, None) for m in months]
    build = lambda poison: [observations(spark, [(s, d, (1e9 if poison and d > "2024-01-15" else v), r) for s, d, v, r in rows]) for rows in (daily(5.0, "r"), daily(4.0, "b"), cpi, un)]
    probe = spark.createDataFrame([(origin,)], "as_of timestamp_ntz")
    a, b = (fc.macro_features(probe, *build(p)).first() for p in (False, True))
    assert a.yield_spread == pytest.approx(-1.0) and a.rate_momentum == 0.0
    assert a.inflation_gap == pytest.approx(0.0, abs=1e-9) and a.unemployment_momentum == 0.0
    assert a == b


def test_price_outcome_on_and_off_session(spark):
    obs = observations(spark, [("p", f"2024-01-{d:02d}", v, None) for d, v in [(1, 10), (2, 11), (3, 13), (4, 16), (5, 20)]])
    o = spark.createDataFrame([("p", ts("2024-01-01")), ("p", ts("2024-01-01 12:00:00")), ("p", ts("2024-01-04")), ("p", ts("2024-01-05"))], "series_id string, as_of timestamp_ntz")
    got = {r.as_of: (r.delta, r.outcome) for r in fc.price_outcome(o, obs, 2.5, 2).collect()}
    assert got[ts("2024-01-01")] == (3.0, 1)  # second session after the 1st is the 3rd
    assert got[ts("2024-01-01 12:00:00")] == (2.0, 0)  # from the 2nd to the second session after noon, the 3rd
    assert got[ts("2024-01-04")] == (4.0, 1)  # history ends early: read at its last session
    assert got[ts("2024-01-05")] == (None, None)


def test_band_probability(spark):
    p = fc.band_shock_probability(F.col("m"), F.col("lo"), F.col("hi"), F.lit(12.0))
    df = spark.createDataFrame([(10.0, 10 - 1.96 * 2, 10 + 1.96 * 2), (10.0, 10.0, 10.0), (13.0, 13.0, 13.0)], "m double, lo double, hi double")
    got = [r.p for r in df.select(p.alias("p")).collect()]
    assert got[0] == pytest.approx(0.15865525393145707) and got[1:] == [0.0, 1.0]


def test_samples_and_wrong_lengths(spark):
    rng = np.random.default_rng(8)
    paths = [rng.normal(size=4).tolist() for _ in range(50)] + [[1.0, 2.0]]
    df = spark.createDataFrame([("k", p) for p in paths], "k string, values array<double>")
    rows = {r.step: r for r in fc.from_samples(df, 4, ["k"]).collect()}
    x = np.array(paths[:50])
    assert set(rows) == {1, 2, 3, 4}
    for step, r in rows.items():
        assert r.n_samples == 50
        assert [q.v for q in r.quantiles] == pytest.approx(np.quantile(x[:, step - 1], sc.QUANTILE_LEVELS))


def test_a_failing_cluster_is_not_a_failing_model(spark, tmp_path, monkeypatch):
    t, s = task_and_spec(spark, "ramp", dates=["2010-01-01"])
    obs = monthly_ramp(spark)
    save = bt.save_results
    calls = []

    def lost(*args, **kwargs):
        calls.append(args)
        if len(calls) == 1:
            raise Py4JError("executor lost")
        return save(*args, **kwargs)

    monkeypatch.setattr(bt, "save_results", lost)
    with pytest.raises(Py4JError):
        bt.cached_backtest(spark, obs, t, s, {"last_value_naive": fc.last_value}, str(tmp_path / "r"))
    assert bt.cached_backtest(spark, obs, t, s, {"last_value_naive": fc.last_value}, str(tmp_path / "r")).count() == 1


def test_cached_backtest_computes_only_the_rest(spark, tmp_path):
    obs = monthly_ramp(spark).unionByName(monthly_ramp(spark).withColumn("series_id", F.lit("other")))
    t1, s1 = task_and_spec(spark, "ramp")
    t2, s2 = task_and_spec(spark, "other")
    calls = []

    def counting(ctx, o):
        calls.append(sorted(r.task_id for r in ctx.select("task_id").distinct().collect()))
        return fc.last_value(ctx, o)

    def broken(ctx, o):
        raise ValueError("no")

    path = str(tmp_path / "results")
    bt.cached_backtest(spark, obs, t1, s1, {"last_value_naive": counting}, path)
    both = bt.cached_backtest(spark, obs, t1.unionByName(t2), s1.unionByName(s2), {"last_value_naive": counting, "broken": broken}, path)
    assert calls == [["t_ramp"], ["t_other"]]
    assert both.groupBy("task_id").count().collect() and both.count() == 10


def test_run_budget(spark, tmp_path):
    obs = monthly_ramp(spark)
    t, s = task_and_spec(spark, "ramp", max_runs=2)
    path = str(tmp_path / "ledger")
    numbers = [bt.evaluate(spark, obs, t, s, {"n": fc.last_value}, path).first().run_number for _ in range(2)]
    assert numbers == [1, 2]
    with pytest.raises(RuntimeError, match="budget"):
        bt.evaluate(spark, obs, t, s, {"n": fc.last_value}, path)


def test_resolution_respects_now_and_duplicates(spark):
    obs = observations(spark, [("a", "2024-01-01", 1, "2024-01-02"), ("a", "2024-01-02", 2, "2024-01-20"), ("a", "2024-01-02", 9, "2024-02-20")])
    p = spark.createDataFrame([("a", ts("2024-01-02"))], "series_id string, forecast_date timestamp_ntz")
    assert bt.resolve(p, obs).first().actual == 2.0
    assert bt.resolve(p, obs, F.lit("2024-01-10").cast("timestamp_ntz")).count() == 0
    assert bt.resolve(p, obs, F.lit("2024-01-10").cast("timestamp_ntz"), keep_unresolved=True).first().actual is None
