import itertools

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Window, functions as F

from helpers import OBS, observations, ts
from tidemark.operators import asof, ordered

HOURS = 3600


@pytest.fixture(scope="module")
def messy(spark):
    """Two series, uneven days, releases out of order, some missing; one series much longer than the other."""
    rng = np.random.default_rng(3)
    rows = []
    for name, n in (("hot", 400), ("cold", 60)):
        days = np.sort(rng.choice(900, n, replace=False))
        for d in days:
            t = pd.Timestamp("2020-01-01") + pd.Timedelta(days=int(d))
            r = None if rng.random() < 0.1 else (t + pd.Timedelta(days=int(rng.integers(0, 60)))).to_pydatetime()
            rows.append((name, t.to_pydatetime(), float(rng.integers(0, 50)), r))
    return spark.createDataFrame(rows, OBS).cache()


@pytest.fixture(scope="module")
def probes(spark):
    days = [pd.Timestamp("2019-12-15") + pd.Timedelta(days=int(d)) for d in range(0, 980, 23)]
    return spark.createDataFrame([(s, d.to_pydatetime()) for s, d in itertools.product(("hot", "cold"), days)], "series_id string, as_of timestamp_ntz")


def test_cutoff_known_answers(spark):
    two = observations(spark, [("a", "2022-01-01", 1, None), ("a", "2022-02-01", 2, None)])
    assert asof.as_of(two, "2022-02-01").count() == 2
    lag = observations(spark, [("a", "2022-01-01", 1, "2022-01-20"), ("a", "2022-02-01", 2, "2022-02-21")])
    assert asof.as_of(lag, "2022-02-15").count() == 1
    null = observations(spark, [("a", "2022-01-01", 1, "2022-01-20"), ("a", "2022-02-01", 2, None)])
    assert asof.as_of(null, "2022-02-15").count() == 2
    assert asof.as_of(null.drop("released_at"), "2022-01-31").count() == 1


@pytest.mark.parametrize("days", [3, 40, 5000])
def test_blocked_running_equals_window(messy, days):
    folds = {"n": ("sum", F.lit(1).cast("long")), "hi": ("max", F.col("value")), "lo": ("min", F.col("value"))}
    w = Window.partitionBy("series_id").orderBy("timestamp").rowsBetween(Window.unboundedPreceding, 0)
    want = messy.select("*", F.count(F.lit(1)).over(w).alias("n"), F.max("value").over(w).alias("hi"), F.min("value").over(w).alias("lo"))
    got = ordered.running(messy, ["series_id"], "timestamp", folds, block_seconds=days * 24 * HOURS)
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


@pytest.mark.parametrize("days", [2, 30, 5000])
def test_blocked_trailing_equals_window(messy, days):
    def build(w):
        return {"p7": F.lag("value", 7).over(w), "m5": F.avg("value").over(w.rowsBetween(-4, 0))}

    w = Window.partitionBy("series_id").orderBy("timestamp")
    want = messy.withColumns(build(w))
    got = ordered.trailing(messy, ["series_id"], "timestamp", 7, build, block_seconds=days * 24 * HOURS)
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0
    back = ordered.leads(messy, ["series_id"], "timestamp", {"n3": ("value", 3)}, block_seconds=days * 24 * HOURS)
    assert back.exceptAll(messy.withColumn("n3", F.lead("value", 3).over(w))).count() == 0


def test_visible_state_brute_force(messy, probes):
    got = {(r.series_id, r.as_of): (r.n_visible, r.last.value if r.last else None) for r in asof.visible_state(probes, messy).collect()}
    pdf = messy.toPandas()
    pdf["rel"] = pdf.released_at.fillna(pdf.timestamp)
    for (s, o), (n, v) in got.items():
        seen = pdf[(pdf.series_id == s) & (pdf.rel <= o)].sort_values("timestamp")
        assert n == len(seen)
        assert (v is None) == seen.empty and (seen.empty or v == seen.value.iloc[-1])


@pytest.mark.parametrize("n", [1, 5, 40])
def test_trailing_visible_brute_force(messy, probes, n):
    got = asof.trailing_visible(probes, messy, n).groupBy("series_id", "as_of").agg(F.sort_array(F.collect_list("timestamp")).alias("t")).collect()
    pdf = messy.toPandas()
    pdf["rel"] = pdf.released_at.fillna(pdf.timestamp)
    found = 0
    for r in got:
        seen = pdf[(pdf.series_id == r.series_id) & (pdf.rel <= r.as_of)].sort_values("timestamp").tail(n)
        assert [t.to_pydatetime() for t in seen.timestamp] == r.t
        found += len(r.t)
    assert found > 0


def test_append_the_future_changes_nothing(spark, messy, probes):
    early = probes.filter(F.col("as_of") <= ts("2021-06-01"))
    late = messy.withColumn("released_at", F.lit("2030-01-01").cast("timestamp_ntz")).withColumn("timestamp", F.timestamp_add("DAY", F.lit(2000), "timestamp"))
    for f in (lambda o: asof.visible_state(early, o), lambda o: asof.trailing_visible(early, o, 5).drop("released_at")):
        a, b = f(messy), f(messy.unionByName(late))
        assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_poisoned_unreleased_rows_change_nothing(messy, probes):
    cut = ts("2021-03-01")
    at = probes.filter(F.col("as_of") <= cut)
    poisoned = messy.withColumn("value", F.when(asof.released() > cut, F.lit(1e9)).otherwise(F.col("value")))
    a, b = asof.visible_state(at, messy), asof.visible_state(at, poisoned)
    assert a.exceptAll(b).count() == 0


def test_around_strict_before_and_bounded_after(spark):
    obs = observations(spark, [("a", "2024-01-01", 5, None), ("a", "2024-01-10", 4, None), ("a", "2024-02-20", 3, None)])
    events = spark.createDataFrame([("a", ts("2024-01-01")), ("a", ts("2024-01-04")), ("a", ts("2024-02-01"))], "series_id string, at_ timestamp_ntz")
    rows = asof.around(events, obs, "at_", 7).collect()
    assert [(r.at_, r.before.value, r.after.value) for r in rows] == [(ts("2024-01-04"), 5.0, 4.0)]


def test_spans_hit_and_range_joins(spark):
    spans = spark.createDataFrame([("a", i, ts(f"2024-01-{lo:02d}"), ts(f"2024-01-{hi:02d}")) for i, (lo, hi) in enumerate([(1, 3), (4, 6), (6, 9)])], "series_id string, i int, lo timestamp_ntz, hi timestamp_ntz")
    points = spark.createDataFrame([("a", ts("2024-01-06")), ("b", ts("2024-01-02"))], "series_id string, t timestamp_ntz")
    hit = {r.i: r.hit for r in asof.spans_hit(spans, points, "lo", "hi", "t", ["series_id"], "hit").collect()}
    assert hit == {0: False, 1: True, 2: True}
    assert asof.intervals_containing(points, spans, "t", "lo", "hi", ["series_id"]).count() == 2
    assert [r.series_id for r in asof.outside_all_spans(points, spans, "t", "lo", "hi", ["series_id"]).collect()] == ["b"]


def test_exact_percentiles(spark):
    rng = np.random.default_rng(6)
    groups = {"many": rng.normal(size=3000).round(2), "ties": np.r_[np.zeros(500), 1.0], "one": np.array([4.0])}
    df = spark.createDataFrame([(k, float(v)) for k, x in groups.items() for v in x] + [("one", None)], "k string, v double")
    levels = {"a": 0.0, "b": 0.25, "c": 0.8, "d": 0.999, "e": 1.0}
    for r in ordered.exact_percentiles(df, ["k"], "v", levels).collect():
        assert [r[n] for n in levels] == pytest.approx(list(np.quantile(groups[r.k], list(levels.values()))))
