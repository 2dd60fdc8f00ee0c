"""Backtests end to end: budgets, caching, resolution and scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.functions import scoring as sc
from tidemark.operators import forecast as fc
from tidemark.plans import backtest as bt
from tidemark.queries.forecasts import _DECISION_PROBS, _SHOCK_ORIGINS, decision_setup, shock_setup
from tidemark.queries.registry import query
from tidemark.queries.sources import _folder
from tidemark.queries.tables import DIRECTIONS, FORECASTERS, origins, scored, setup, specs, sql

_SUMMARY = """
SELECT predictor_id, task_id, 'crps' AS metric, round(avg(score), 4) AS mean_score, count(*) AS n_scored,
       (SELECT count(*) FROM origins o WHERE o.task_id = s.task_id) - count(DISTINCT as_of) AS n_skipped_origins
FROM scored s GROUP BY 1, 2"""


@query("H1 H2 A2 A5 A6 J2 C1 M1 M4", sql("scored", _SUMMARY))
def backtest_summary(spark: SparkSession, sf: str) -> DataFrame:
    """Flagship: mean CRPS, scored rows and skipped origins of two forecasters on every series."""
    obs, t, s = setup(spark, sf)
    summary = bt.summarise(bt.backtest(obs, t, s, FORECASTERS), bt.origin_table(t, s))
    return summary.select("predictor_id", "task_id", "metric", F.round("mean_score", 4).alias("mean_score"), "n_scored", "n_skipped_origins")


@query("J2 A2", sql("scored", "SELECT predictor_id, task_id, as_of, horizon, forecast_date, actual, round(score, 5) AS score FROM scored"))
def scored_predictions(spark: SparkSession, sf: str) -> DataFrame:
    """Every resolved prediction with its CRPS."""
    return scored(spark, sf).select("predictor_id", "task_id", "as_of", "horizon", "forecast_date", "actual", F.round("score", 5).alias("score"))


@query("J2 P2", sql("scored obs", """
SELECT s.predictor_id, s.task_id, count(*) AS n, round(avg(s.score), 4) AS mean_score
FROM scored s JOIN obs o ON o.series_id = s.series_id AND o.timestamp = s.forecast_date WHERE o.released_at <= TIMESTAMP '1999-12-31' GROUP BY 1, 2"""))
def resolved_as_of(spark: SparkSession, sf: str) -> DataFrame:
    """Scores counting only outcomes released by the end of 1999."""
    obs, t, s = setup(spark, sf)
    now = F.lit("1999-12-31").cast("timestamp_ntz")
    out = bt.backtest(obs, t, s, FORECASTERS, now)
    return out.groupBy("predictor_id", "task_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("score"), 4).alias("mean_score"))


@query("A3 A25 H1", sql("prices", _SHOCK_ORIGINS + """
, p AS (SELECT series_id, as_of, avg(value) AS p FROM so JOIN flags USING (series_id) WHERE released_at <= as_of GROUP BY 1, 2 HAVING count(*) >= 60)
SELECT p.series_id, count(*) AS n, round(avg((p.p - f.value) * (p.p - f.value)), 8) AS mean_brier
FROM p JOIN flags f ON f.series_id = p.series_id AND f.timestamp = p.as_of + to_days(CAST(CASE isodow(p.as_of) WHEN 5 THEN 3 ELSE 1 END AS INTEGER)) GROUP BY 1""").replace(")\n\n,", "),\n"))
def brier_backtest(spark: SparkSession, sf: str) -> DataFrame:
    """Next-session shock probabilities scored by Brier."""
    obs, t, s = shock_setup(spark, sf)
    out = bt.backtest(obs, t, s, {"hf": fc.historical_frequency})
    return out.groupBy("series_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("score"), 8).alias("mean_brier"))


@query("A4 A26 H1 T8", sql("decisions", _DECISION_PROBS + """
SELECT series_id, forecast_date, round((p_down - (actual <= -1)::INT) ** 2 + (p_down + p_same - (actual <= 0)::INT) ** 2, 8) AS rps,
  CASE WHEN p_down >= p_same AND p_down >= p_up THEN 'down' WHEN p_same >= p_up THEN 'same' ELSE 'up' END AS likeliest FROM probs"""))
def rps_backtest(spark: SparkSession, sf: str) -> DataFrame:
    """Ordered-category forecasts scored by RPS, with the likeliest label."""
    obs, t, s = decision_setup(spark, sf)
    out = bt.backtest(obs, t, s, {"cf": lambda c, o: fc.category_frequency(c, o, DIRECTIONS)})
    return out.select("series_id", "forecast_date", F.round("score", 8).alias("rps"), sc.argmax_label(F.col("probs"), F.col("categories")).alias("likeliest"))


@query("S17 S15 S16", sql("scored", "SELECT predictor_id, task_id, count(*) AS n, round(avg(score), 4) AS mean_score FROM scored GROUP BY 1, 2"))
def cached_backtest(spark: SparkSession, sf: str) -> DataFrame:
    """Two series stored first; the second call computes only the missing ones and returns them all."""
    obs, t, s = setup(spark, sf)
    path = _folder(spark, "cache")
    some = s.filter(F.col("task_id").isin("next_1-URGENT", "next_5-LOW"))
    bt.cached_backtest(spark, obs, t, some, FORECASTERS, path)
    out = bt.cached_backtest(spark, obs, t, s, FORECASTERS, path)
    return out.groupBy("predictor_id", "task_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("score"), 4).alias("mean_score"))


@query("S23 H3", sql("scored", "SELECT task_id, 2::BIGINT AS run_number, count(*) AS n, round(avg(score), 4) AS mean_score FROM scored WHERE predictor_id = 'last_value_naive' GROUP BY 1"))
def budgeted_evaluation(spark: SparkSession, sf: str) -> DataFrame:
    """Two runs of a spec limited to two; the second carries run number 2."""
    obs, t, _ = setup(spark, sf)
    s = specs(t, max_runs=2)
    ledger = _folder(spark, "ledger")
    naive = {"last_value_naive": fc.last_value}
    bt.evaluate(spark, obs, t, s, naive, ledger)
    out = bt.evaluate(spark, obs, t, s, naive, ledger)
    return out.groupBy("task_id", "run_number").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("score"), 4).alias("mean_score"))


@query("P15 H2", "SELECT CAST(0 AS BIGINT) AS n_mixed, count(DISTINCT o_orderpriority) AS n_specs FROM orders")
def one_frequency_per_spec(spark: SparkSession, sf: str) -> DataFrame:
    """Multi-target specs must share one frequency."""
    _, t, s = setup(spark, sf)
    mixed = bt.mixed_frequency_specs(t, s).agg(F.count(F.lit(1)).alias("n_mixed"))
    return mixed.join(F.broadcast(s.agg(F.count(F.lit(1)).alias("n_specs"))))


@query("J14 U2", sql("scored origins", """
SELECT 'weekly' AS spec_id, o.task_id, count(*) AS n_dropped FROM origins o
WHERE NOT EXISTS (SELECT 1 FROM scored s WHERE s.task_id = o.task_id AND s.as_of = o.as_of GROUP BY s.as_of HAVING count(DISTINCT predictor_id) = 2) GROUP BY 2"""))
def dropped_origins(spark: SparkSession, sf: str) -> DataFrame:
    """Origins of each task outside the set every forecaster was scored on."""
    from tidemark.operators.analysis import dropped_origins as dropped
    from tidemark.session import settled

    return dropped(origins(spark, sf), settled(scored(spark, sf), "scored"), ("spec_id", "task_id"))
