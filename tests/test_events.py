import datetime as dt
import hashlib
from collections import defaultdict

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from helpers import observations, price_path, ts
from tidemark.operators import events as ev
from tidemark.plans import study


@pytest.fixture(scope="module")
def path(spark):
    rng = np.random.default_rng(11)
    r = rng.normal(0, 1.5, 900)
    r[rng.choice(np.arange(40, 900), 70, replace=False)] = rng.choice([-7, 6, 8], 70)
    return price_path(spark, r.tolist(), start="2021-01-04").cache()


@pytest.fixture(scope="module")
def days(path):
    return ev.sessions(path).cache()


LO, HI = "2023-02-01", "2023-12-29"


def test_shock_clusters(spark):
    d = ev.sessions(price_path(spark, [1, 6, -9, 7, 0.5, 0.2, 5.5, 0]))
    rows = ev.shock_windows(d, 5.0).orderBy("event_date").collect()
    bd = [x.to_pydatetime() for x in pd.bdate_range("2024-01-01", periods=9)]
    assert [(r.as_of, r.event_date, r.direction) for r in rows] == [(bd[1], bd[3], "down"), (bd[6], bd[7], "up")]
    assert rows[0].return_pct == pytest.approx(-9)


def test_overlapping_horizons_merge(spark):
    d = ev.sessions(price_path(spark, [0, 0, 6, 0, 0, 0, 0, 0]))
    rows = ev.shock_windows(d, 5.0, horizon=3).collect()
    bd = [x.to_pydatetime() for x in pd.bdate_range("2024-01-01", periods=9)]
    # The jump is in the 3-session return of three days; they are one event, as_of three sessions before the first.
    assert [(r.as_of, r.event_date) for r in rows] == [(bd[0], bd[3])]


def test_no_shocks(spark):
    assert ev.shock_windows(ev.sessions(price_path(spark, [0.1, 0.2])), 5.0).count() == 0


def test_controls_keep_their_invariants(days):
    shocks = ev.shock_windows(days, 5.0)
    pool = ev.control_candidates(days, shocks, 5.0, LO, HI)
    controls = ev.matched_controls(days, pool, 1, seed=3).toPandas()
    assert len(controls) > 30 and controls.event_idx.is_unique
    d = days.toPandas().set_index("idx").sort_index()
    near = {int(i) + o for i in d.index[d.return_pct.abs() >= 5] for o in range(-2, 3)}
    for w in shocks.collect():
        near |= set(range(w.as_of_idx - 2, w.event_idx + 3))
    assert not near & set(controls.event_idx)
    period = lambda x: np.where(x < pd.Timestamp(LO), 0, np.where(x <= pd.Timestamp(HI), 1, 2))
    assert (period(controls.as_of) == period(controls.event_date)).all()
    again = ev.matched_controls(days, pool, 1, seed=3).toPandas()
    assert sorted(again.event_idx) == sorted(controls.event_idx)


def drawn_by_hand(rows, n, seed):
    """The rounds of proposals in plain Python; rows: (series, shock_date, idx, distance)."""
    code = lambda *x: hashlib.md5("|".join(map(str, (seed, *x))).encode()).hexdigest()
    free, picked = defaultdict(dict), defaultdict(set)
    for s, d, i, x in rows:
        free[s, d][i] = x
    while free:
        wanted = defaultdict(list)
        for (s, d), left in free.items():
            near = sorted(left, key=lambda i: (left[i] is None, left[i] or 0, i))
            if any(x is not None for x in left.values()):
                near = near[: 5 * n]
            for i in sorted(near, key=lambda i: code(s, d, i))[: n - len(picked[s, d])]:
                wanted[s, i].append(d)
        for (s, i), who in wanted.items():
            picked[s, min(who, key=lambda d: code(s, d))].add(i)
        taken = {(s, i) for (s, _), ids in picked.items() for i in ids}
        free = {(s, d): kept for (s, d), left in free.items() if len(picked[s, d]) < n and (kept := {i: x for i, x in left.items() if (s, i) not in taken})}
    return {(s, str(d), i) for (s, d), ids in picked.items() for i in ids}


@pytest.mark.parametrize("n", [1, 3])
def test_drawn_controls_as_by_hand(spark, days, n):
    """Real candidates, and shocks that compete for too few candidates or have no distances."""
    real = ev.control_candidates(days, ev.shock_windows(days, 5.0), 5.0, LO, HI).select("series_id", "shock_date", "idx", "event_date", "return_pct", "distance")
    rng = np.random.default_rng(n)
    day = lambda i: ts("2024-01-01") + dt.timedelta(days=int(i))
    tight = [(s, day(d), int(i), day(i), 0.0, None if s == "blind" else float(rng.integers(0, 4))) for s in ("tight", "blind") for d in range(12) for i in rng.choice(20, 8, replace=False)]
    pool = real.unionByName(spark.createDataFrame(tight, real.schema)).repartition(3)
    got = {(r.series_id, str(r.shock_date), r.idx) for r in ev.draw_controls(pool, n, seed=4).collect()}
    assert got == drawn_by_hand([(r.series_id, r.shock_date, r.idx, r.distance) for r in pool.collect()], n, 4)
    assert len({(s, i) for s, _, i in got}) == len(got)
    windows = pool.select("series_id", F.col("shock_date").alias("event_date")).distinct()
    short = {r.series_id: r.n_missing for r in ev.control_shortage(windows, ev.draw_controls(pool, n, seed=4), n).collect()}
    shocks = {(r.series_id, str(r.event_date)) for r in windows.collect()}
    assert short == {s: sum(n - sum(g[:2] == x for g in got) for x in shocks if x[0] == s) for s in {x[0] for x in shocks}}
    assert n == 1 or short["tight"] >= 16


def test_no_candidates(spark, days):
    none = ev.control_candidates(days, ev.shock_windows(days, 5.0), 5.0, LO, HI).limit(0)
    assert ev.matched_controls(days, none).count() == 0


def test_control_candidates_lie_in_reach(days):
    pool = ev.control_candidates(days, ev.shock_windows(days, 5.0), 5.0, LO, HI)
    idx = days.select(F.col("timestamp").alias("shock_date"), F.col("idx").alias("shock_idx"))
    assert pool.join(idx, "shock_date").filter(F.abs(F.col("idx") - F.col("shock_idx")) > 126).count() == 0
    assert pool.groupBy("shock_date").count().filter("count > 253").count() == 0


def test_regimes_match_expanding_quantiles_and_never_change(path, days):
    got = ev.volatility_regimes(days).toPandas().sort_values("timestamp")
    vol = got.vol.astype(float)
    lo, hi = (vol.expanding(252).quantile(q) for q in (0.33, 0.67))
    want = np.where(vol < lo, "low", np.where(vol > hi, "high", "normal"))
    known = lo.notna() & vol.notna()
    assert (got.regime[known].to_numpy() == want[known]).all() and got.regime[~known].isna().all()
    early = ev.volatility_regimes(ev.sessions(path.filter(F.col("timestamp") < ts("2023-06-01")))).toPandas().sort_values("timestamp")
    assert early.regime.tolist() == got.regime.tolist()[: len(early)]


def evidence(spark, rows):
    """rows: pattern, split, hits, shocks, false matches, controls, base rate."""
    counts = spark.createDataFrame(
        [("s", p, sp, "either", s + c, h + f, h, s, c) for p, sp, h, s, f, c, _ in rows],
        "series_id string, pattern_id string, split string, direction_wanted string, n_windows long, n_matches long, n_hits long, n_shocks long, n_controls long",
    )
    bases = spark.createDataFrame([("s", sp, "either", b) for sp, b in {(r[1], r[6]) for r in rows}], "series_id string, split string, direction string, base_rate double")
    return ev.pattern_metrics(counts, bases)


def test_metrics_known_values(spark):
    rows = {r.pattern_id: r for r in evidence(spark, [("a", "train", 6, 10, 2, 10, 0.12), ("none", "train", 0, 10, 0, 10, 0.12)]).collect()}
    a = rows["a"]
    assert a.lift == pytest.approx(0.6 / (0.6 * 0.12 + 0.2 * 0.88)) and a.precision == pytest.approx(a.lift * 0.12)
    assert a.ci_low < a.lift < a.ci_high
    none = rows["none"]
    assert none.lift is None and none.p_value == 1.0 and none.ci_low is None


def test_gate_and_reasons(spark):
    good = [("good", "train", 30, 60, 3, 60, 0.1), ("good", "holdout", 8, 13, 1, 13, 0.1)]
    weak = [("weak", "train", 2, 60, 2, 60, 0.1), ("weak", "holdout", 0, 13, 0, 13, 0.1)]
    v = {r.pattern_id: r for r in study.verdicts(evidence(spark, good + weak)).collect()}
    assert v["good"].graduates and v["good"].reasons == [] and v["good"].why_not == "graduated"
    assert set(v["weak"].reasons) == {"train_matches", "train_lift", "train_p_value", "train_interval", "holdout_untested"}
    after = [("late", "train", 20, 60, 20, 60, 0.1), ("late", "holdout", 8, 13, 1, 13, 0.1)]
    assert study.verdicts(evidence(spark, after)).first().why_not == "real after the cutoff, not before"


def test_direction_aware_counts(spark):
    w = spark.createDataFrame(
        [("s", "train", True, "up", True), ("s", "train", True, "down", True), ("s", "train", False, None, False)],
        "series_id string, split string, is_shock boolean, direction string, match boolean",
    ).withColumn("pattern_id", F.lit("p"))
    r = ev.evidence_counts(w, {"p": "up"}).first()
    assert (r.n_matches, r.n_hits, r.n_shocks, r.n_controls) == (2, 1, 1, 2)


def test_split_needs_both_ends_inside_the_holdout(spark):
    w = spark.createDataFrame(
        [(ts("2023-01-30"), ts("2023-01-31")), (ts("2023-01-31"), ts("2023-02-01")), (ts("2023-02-01"), ts("2023-02-02")), (ts("2023-12-29"), ts("2024-01-02"))],
        "as_of timestamp_ntz, event_date timestamp_ntz",
    )
    assert [r.split for r in ev.train_holdout(w, LO, HI).orderBy("as_of").collect()] == ["train", None, "holdout", None]


def test_study_set_holdout_controls(days):
    w = study.study_set(days, 5.0, LO, HI, holdout_controls=3)
    n = {(r.split, r.is_shock): r.n for r in w.groupBy("split", "is_shock").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert n[("holdout", False)] > n[("holdout", True)] and n[("train", False)] <= n[("train", True)]
    assert ev.small_splits(w, 10).count() == 0 and ev.small_splits(w, 10_000).count() == 2


def test_decisions_next_day_effect_and_unresolved(spark):
    rate = observations(spark, [("r", d.strftime("%Y-%m-%d"), 5.0 if d < pd.Timestamp("2024-06-06") else 4.75, None) for d in pd.bdate_range("2024-05-01", "2024-07-01")])
    cal = spark.createDataFrame([("r", ts("2024-06-05")), ("r", ts("2024-05-15")), ("r", ts("2024-09-01"))], "series_id string, announced_at timestamp_ntz")
    got = {r.timestamp: r.value for r in ev.decision_outcomes(cal, rate).collect()}
    assert got == {ts("2024-06-05"): -1.0, ts("2024-05-15"): 0.0}
    assert ev.unexplained_changes(rate, cal).count() == 0
    early = cal.filter(F.col("announced_at") != ts("2024-06-05"))
    assert [r.timestamp for r in ev.unexplained_changes(rate, early).collect()] == [ts("2024-06-06")]


def test_paired_bootstrap_brackets_the_mean(spark):
    rng = np.random.default_rng(9)
    x = rng.normal(0.3, 1, 120)
    d = spark.createDataFrame([("a", (pd.Timestamp("2024-01-01") + pd.Timedelta(days=i)).to_pydatetime(), float(v)) for i, v in enumerate(x)], "arm string, as_of timestamp_ntz, diff double")
    r = ev.paired_bootstrap(d, ["arm"], resamples=800).first()
    se = x.std(ddof=1) / np.sqrt(120)
    assert r.diff_lo == pytest.approx(x.mean() - 1.645 * se, abs=0.35 * se) and r.diff_hi == pytest.approx(x.mean() + 1.645 * se, abs=0.35 * se)
    again = ev.paired_bootstrap(d.repartition(7), ["arm"], resamples=800).first()
    assert (again.diff_lo, again.diff_hi) == pytest.approx((r.diff_lo, r.diff_hi))  # same draws; sums differ in the last bit


def test_quotes(spark):
    df = spark.createDataFrame([("closed at 101.54 today", 101.548), ("about 99", 101.54)], "t string, v double")
    assert [r.q for r in df.select(ev.quotes_value(F.col("t"), F.col("v")).alias("q")).collect()] == [True, False]
