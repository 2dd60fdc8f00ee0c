import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from helpers import observations, ts
from tidemark.operators import analysis as an
from tidemark.functions import scoring as sc


def test_calibration_edge(spark):
    df = spark.createDataFrame([("a", 0.6, 1.0), ("a", 1.0, 1.0), ("a", 0.05, 0.0), ("a", None, 1.0)], "predictor_id string, probability double, outcome double")
    rows = {r.bin_left: r for r in an.calibration(df).collect()}
    assert set(rows) == {0.0, 0.4, 0.8} and rows[0.4].bin_right == 0.6000000000000001


def test_binary_metrics_against_definitions(spark):
    rng = np.random.default_rng(0)
    y, s = rng.integers(0, 2, 300), rng.integers(0, 20, 300) / 20
    p = (s > 0.5).astype(int)
    df = spark.createDataFrame([("k", int(a), int(b), float(c)) for a, b, c in zip(y, p, s)], "k string, actual_up int, pred_up int, prob_up double")
    r = an.binary_metrics(df, ["k"]).first()
    pos, neg = s[y == 1], s[y == 0]
    auc = ((pos[:, None] > neg[None, :]).mean() + 0.5 * (pos[:, None] == neg[None, :]).mean())
    assert r.roc_auc == pytest.approx(auc) and r.accuracy == pytest.approx((y == p).mean())
    assert r.matthews_corrcoef == pytest.approx(np.corrcoef(y, p)[0, 1])
    assert r.majority_baseline == pytest.approx(max(y.mean(), 1 - y.mean()))


def test_binary_metrics_single_class(spark):
    df = spark.createDataFrame([("k", 1, 1, 0.5), ("k", 1, 0, 0.5)], "k string, actual_up int, pred_up int, prob_up double")
    r = an.binary_metrics(df, ["k"]).first()
    assert r.roc_auc is None and r.balanced_accuracy == 0.5 and r.precision_down == 0.0 and r.matthews_corrcoef == 0.0


def scored(spark, rows):
    return spark.createDataFrame([(p, t, ts(o), h, float(s)) for p, t, o, h, s in rows], "predictor_id string, task_id string, as_of timestamp_ntz, horizon int, score double").withColumn("spec_id", F.lit("s"))


def test_margins(spark):
    df = scored(spark, [("a", "x", "2024-01-01", 1, 1), ("a", "x", "2024-01-02", 1, 3), ("a", "y", "2024-01-01", 2, 10)])
    m = {r.task_id: r.a for r in an.task_matrix(df, ["x", "y"], ["a"]).collect()}
    assert m == {"x": 2.0, "y": 10.0, "MEAN": 6.0}  # mean of means
    assert an.horizon_matrix(df, [1, 2]).first()["All"] == pytest.approx(14 / 3)  # pooled rows


def test_shared_origins_and_pairs(spark):
    df = scored(spark, [("a", "x", "2024-01-01", 1, 1), ("b", "x", "2024-01-01", 1, 3), ("a", "x", "2024-01-02", 1, 5)])
    assert an.shared_origins(df).count() == 2
    assert [r["diff"] for r in an.paired_differences(df, "a", "b", ["task_id", "as_of", "horizon"]).collect()] == [-2.0]
    assert an.without_worst_origin(df).filter("predictor_id = 'a'").first().mean_score == 1.0
    c = an.concentration(df, 1).first()
    assert c.n_origins == 2 and c.worst_share == pytest.approx(5 / 9)


def test_flat_average_yoy_is_zero(spark):
    months = pd.date_range("2020-01-01", "2022-12-01", freq="MS")
    obs = observations(spark, [("a", m.strftime("%Y-%m-%d"), 100, None) for m in months])
    p = spark.createDataFrame([("n", "t", "a", ts("2020-07-01"), m.to_pydatetime(), 100.0) for m in months[12:24]], "predictor_id string, task_id string, series_id string, as_of timestamp_ntz, forecast_date timestamp_ntz, point double")
    r = an.average_yoy(p.withColumn("quantiles", sc.point_mass(F.col("point"))), obs).first()
    assert (r.yoy_median, r.yoy_q25, r.actual_yoy) == (0.0, 0.0, 0.0)
    short = an.average_yoy(p.withColumn("quantiles", sc.point_mass(F.col("point"))), obs.filter(F.col("timestamp") != ts("2020-03-01")))
    assert short.count() == 0


def test_families_and_prefixes(spark):
    df = spark.createDataFrame([("last_value_naive",), ("auto_arima",), ("news_agent",), ("x",)], "n string")
    assert [r.f for r in df.select(an.predictor_family(F.col("n")).alias("f")).collect()] == ["Baseline", "Numerical ML", "LLM / Agent", "Other"]
    arms = spark.createDataFrame([("agent_a_1",), ("agent_b",), ("agentx_y",)], "n string")
    assert [r.arm for r in an.longest_prefix_label(arms, "n", {"agent": "Agent", "agent_a": "Agent A"}).collect()] == ["Agent A", "Agent", "agentx y"]


def test_skill_hidden_for_nonpositive_reference(spark):
    b = spark.createDataFrame([("ref", 0.0), ("m", 1.0)], "predictor_id string, mean_score double")
    assert all(r.skill_vs_reference is None for r in an.with_skill(b, "ref").collect())
    b = spark.createDataFrame([("ref", 2.0), ("m", 1.0)], "predictor_id string, mean_score double")
    assert {r.predictor_id: r.skill_vs_reference for r in an.with_skill(b, "ref").collect()} == {"ref": 0.0, "m": 0.5}


def test_gap_positions(spark):
    days = [d for d in pd.bdate_range("2024-01-01", "2024-02-09") if d != pd.Timestamp("2024-02-07")]
    obs = observations(spark, [("a", d.strftime("%Y-%m-%d"), 1, d.strftime("%Y-%m-%d")) for d in days])
    o = spark.createDataFrame([("a", ts("2024-02-06")), ("a", ts("2024-02-09"))], "series_id string, as_of timestamp_ntz")
    got = {r.as_of: (r.nearest_missing, r.rows_from_end) for r in an.gap_positions(o, obs).collect()}
    assert got == {ts("2024-02-06"): (None, None), ts("2024-02-09"): (ts("2024-02-07"), 2)}


def test_a_late_session_is_missing_until_it_is_out(spark):
    days = pd.bdate_range("2024-01-01", "2024-02-09")
    out = lambda d: "2024-02-08" if d == pd.Timestamp("2024-02-01") else d.strftime("%Y-%m-%d")
    obs = observations(spark, [("a", d.strftime("%Y-%m-%d"), 1, out(d)) for d in days])
    o = spark.createDataFrame([("a", ts(f"2024-02-0{d}")) for d in (1, 2, 7, 8)], "series_id string, as_of timestamp_ntz")
    got = {r.as_of.day: (r.nearest_missing, r.rows_from_end) for r in an.gap_positions(o, obs).collect()}
    gone = ts("2024-02-01")
    assert got == {1: (None, None), 2: (gone, 1), 7: (gone, 4), 8: (None, None)}


def test_volatility_regime_known(spark):
    x = np.exp(np.cumsum(np.tile([0.01, -0.01], 20)))
    obs = observations(spark, [("a", d.strftime("%Y-%m-%d"), float(v), None) for d, v in zip(pd.bdate_range("2024-01-01", periods=40), x)])
    o = spark.createDataFrame([("a", ts("2024-01-03")), ("a", ts("2024-02-20"))], "series_id string, as_of timestamp_ntz")
    got = {r.as_of: r for r in an.volatility_regime(o, obs).collect()}
    assert got[ts("2024-01-03")].regime == "unknown"
    assert got[ts("2024-02-20")].regime == "medium" and got[ts("2024-02-20")].annual_vol == pytest.approx(0.01 * np.sqrt(252) * 100)
