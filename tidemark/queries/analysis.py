"""Tables over scored forecasts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.functions import calendar as cal, scoring as sc
from tidemark.operators import analysis as an, asof, forecast as fc
from tidemark.plans import backtest as bt
from tidemark.queries.forecasts import _DECISION_PROBS, decision_setup
from tidemark.queries.registry import query
from tidemark.queries.tables import (
    DIRECTIONS, END, FORECASTERS, HORIZONS, START, STRIDE, category_column, decisions, frame, monthly, prices, rounded, scored, setup, specs, sql, table, tasks,
)
from tidemark.session import settled

PREDICTORS = list(FORECASTERS)


@query("J3 A15", sql("frame", """
SELECT predictor_id, task_id, as_of, horizon, round(error, 5) AS error, round(width80, 3) AS width80, inside80 FROM frame"""))
def aligned_forecasts(spark: SparkSession, sf: str) -> DataFrame:
    """Every forecast beside its outcome; unresolved rows keep null errors."""
    f = frame(spark, sf)
    return f.select("predictor_id", "task_id", "as_of", "horizon", F.round("error", 5).alias("error"), F.round("width80", 3).alias("width80"), "inside80")


@query("A8 A9 P19", sql("scored", """
SELECT predictor_id, round(avg(score), 4) AS mean_score, round(stddev_samp(score) / sqrt(count(*)), 4) AS se, count(*) AS n, any_value(family) AS family FROM scored GROUP BY 1"""))
def leaderboard(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(an.leaderboard(scored(spark, sf)), 4, "mean_score", "se")


@query("A7", sql("scored", """
, b AS (SELECT predictor_id, task_id, avg(score) AS m, count(*) AS n FROM scored GROUP BY 1, 2)
SELECT b.predictor_id, b.task_id, round(b.m, 4) AS mean_score, b.n, round(1 - b.m / r.m, 4) AS skill_vs_reference
FROM b JOIN b r ON r.task_id = b.task_id AND r.predictor_id = 'last_value_naive'"""))
def skill_leaderboard(spark: SparkSession, sf: str) -> DataFrame:
    """Skill of each forecaster against the naive one, per task."""
    board = settled(an.leaderboard(scored(spark, sf), ("predictor_id", "task_id")), "board")
    out = an.with_skill(board, "last_value_naive", ("task_id",))
    return out.select("predictor_id", "task_id", F.round("mean_score", 4).alias("mean_score"), "n", "skill_vs_reference")


@query("T2", sql("scored", "SELECT predictor_id, round(avg(score), 4) AS mean_score FROM scored GROUP BY 1 ORDER BY 2 LIMIT 1"))
def top_predictor(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(an.top_predictors(an.leaderboard(scored(spark, sf)), 1), 4, "mean_score").select("predictor_id", "mean_score")


@query("A11", sql("scored", """
SELECT predictor_id, round(avg(score) FILTER (WHERE horizon = 5), 4) AS h5, round(avg(score) FILTER (WHERE horizon = 10), 4) AS h10,
       round(avg(score) FILTER (WHERE horizon = 21), 4) AS h21, round(avg(score), 4) AS "all" FROM scored GROUP BY 1"""))
def horizon_matrix(spark: SparkSession, sf: str) -> DataFrame:
    m = an.horizon_matrix(scored(spark, sf), HORIZONS)
    return m.select("predictor_id", *[F.round(F.col(f"`{h}`"), 4).alias(f"h{h}") for h in HORIZONS], F.round("All", 4).alias("all"))


def _task_names(spark: SparkSession, sf: str) -> list[str]:
    return ["next_1-URGENT", "next_2-HIGH", "next_3-MEDIUM", "next_4-NOT SPECIFIED", "next_5-LOW"]


@query("A12", sql("scored", """
, m AS (SELECT task_id, predictor_id, avg(score) AS s FROM scored GROUP BY 1, 2),
b AS (SELECT * FROM m UNION ALL SELECT 'MEAN', predictor_id, avg(s) FROM m GROUP BY 2)
SELECT task_id, round(max(s) FILTER (WHERE predictor_id = 'last_value_naive'), 4) AS naive, round(max(s) FILTER (WHERE predictor_id = 'log_random_walk'), 4) AS walk FROM b GROUP BY 1"""))
def task_matrix(spark: SparkSession, sf: str) -> DataFrame:
    """Task by predictor with a row of means of means."""
    m = an.task_matrix(scored(spark, sf), _task_names(spark, sf), PREDICTORS)
    return m.select("task_id", F.round("last_value_naive", 4).alias("naive"), F.round("log_random_walk", 4).alias("walk"))


@query("A13 J4", sql("scored", """
, m AS (SELECT task_id, predictor_id, avg(ape) AS s FROM scored GROUP BY 1, 2),
b AS (SELECT * FROM m UNION ALL SELECT 'MEAN', predictor_id, avg(s) FROM m GROUP BY 2)
SELECT task_id, round(max(s) FILTER (WHERE predictor_id = 'last_value_naive'), 4) AS naive, round(max(s) FILTER (WHERE predictor_id = 'log_random_walk'), 4) AS walk FROM b GROUP BY 1"""))
def mape_matrix(spark: SparkSession, sf: str) -> DataFrame:
    m = an.task_matrix(an.aligned(scored(spark, sf)), _task_names(spark, sf), PREDICTORS, "ape")
    return m.select("task_id", F.round("last_value_naive", 4).alias("naive"), F.round("log_random_walk", 4).alias("walk"))


@query("A14", sql("scored", "SELECT predictor_id, CAST(year(as_of) AS INTEGER) AS origin_year, round(avg(score), 4) AS mean_score, count(*) AS n FROM scored GROUP BY 1, 2"))
def score_by_year(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(an.by_group(scored(spark, sf), F.year("as_of"), "origin_year"), 4, "mean_score")


@query("A15", sql("frame", """
SELECT predictor_id, round(avg(score), 4) AS mean_score, round(avg(abs_error) FILTER (WHERE horizon = 21), 4) AS mae, round(avg(inside80) * 100, 4) AS coverage_80 FROM frame GROUP BY 1"""))
def score_summary(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(an.score_summary(frame(spark, sf), 21), 4, "mean_score", "mae", "coverage_80")


@query("A16", sql("scored", """
SELECT family, predictor_id, horizon, round(avg(inside80) * 100, 4) AS coverage, round(avg(width80), 2) AS width, round(avg(score), 4) AS mean_score, count(*) AS n,
       round(avg(inside80) * 100 - 80, 4) AS miscalibration FROM scored GROUP BY 1, 2, 3"""))
def coverage_table(spark: SparkSession, sf: str) -> DataFrame:
    t = an.coverage_table(an.aligned(scored(spark, sf)))
    return rounded(rounded(t, 4, "coverage", "mean_score", "miscalibration"), 2, "width")


@query("A17", sql("frame", """
SELECT predictor_id, CASE WHEN as_of < TIMESTAMP '1999-01-01' THEN 'before' ELSE 'after' END AS period, count(abs_error) AS n, round(avg(inside80) * 100, 4) AS coverage,
  round(avg(abs_error), 4) AS mean_abs_error, round(quantile_cont(abs_error, 0.5), 4) AS median_abs_error, round(max(abs_error), 4) AS max_abs_error FROM frame GROUP BY 1, 2"""))
def error_by_period(spark: SparkSession, sf: str) -> DataFrame:
    """Coverage and errors before and after a break."""
    period = F.when(F.col("as_of") < F.lit("1999-01-01").cast("timestamp_ntz"), F.lit("before")).otherwise(F.lit("after"))
    return rounded(an.error_by_period(frame(spark, sf), period), 4, "coverage", "mean_abs_error", "median_abs_error", "max_abs_error")


@query("A37 P28", sql("frame", """
SELECT predictor_id, horizon, count(abs_error) AS n_resolved, count(*) FILTER (WHERE abs_error IS NULL) AS n_unresolved, round(avg(inside80), 6) AS coverage, round(avg(error), 4) AS mean_bias,
  round(avg(abs_error), 4) AS mae, round(avg(width80) FILTER (WHERE abs_error IS NOT NULL), 2) AS ci_width, round(quantile_cont(abs_error, 0.8), 4) AS needed_half_width,
  CASE WHEN avg(inside80) < 0.7 THEN 'too narrow' WHEN avg(inside80) > 0.9 THEN 'conservative' ELSE 'on target' END AS verdict
FROM frame WHERE CAST(as_of AS DATE) BETWEEN DATE '1997-01-01' AND DATE '2000-12-31' GROUP BY 1, 2"""))
def error_report(spark: SparkSession, sf: str) -> DataFrame:
    """Per-horizon report over a dated slice of origins."""
    f = frame(spark, sf).filter(F.to_date("as_of").between("1997-01-01", "2000-12-31"))
    return rounded(rounded(rounded(an.error_report(f), 6, "coverage"), 4, "mean_bias", "mae", "needed_half_width"), 2, "ci_width")


_REGIME = """
, steps AS (SELECT series_id, timestamp, ln(value) - ln(lag(value) OVER (PARTITION BY series_id ORDER BY timestamp)) AS s, value FROM obs),
vol AS (SELECT series_id, timestamp, stddev_pop(s) OVER w * sqrt(252.0) * 100 AS v, count(value) OVER x AS n FROM steps
  WINDOW w AS (PARTITION BY series_id ORDER BY timestamp ROWS BETWEEN 19 PRECEDING AND CURRENT ROW), x AS (PARTITION BY series_id ORDER BY timestamp ROWS BETWEEN 20 PRECEDING AND CURRENT ROW)),
regimes AS (SELECT o.series_id, o.as_of, CASE WHEN v.n IS NULL OR v.n < 5 THEN 'unknown' WHEN v.v < 15 THEN 'low' WHEN v.v < 30 THEN 'medium' WHEN v.v < 50 THEN 'elevated' ELSE 'extreme' END AS regime, v.v
  FROM origins o ASOF LEFT JOIN vol v ON v.series_id = o.series_id AND o.as_of >= v.timestamp)"""


@query("W8", sql("origins obs", _REGIME + " SELECT series_id, as_of, regime, round(v, 6) AS annual_vol FROM regimes"))
def origin_volatility_regime(spark: SparkSession, sf: str) -> DataFrame:
    """Annualised volatility label of the 21 prices before each origin."""
    obs, t, s = setup(spark, sf)
    o = bt.origin_table(t, s).select("series_id", "as_of")
    return rounded(an.volatility_regime(o, obs), 6, "annual_vol").select("series_id", "as_of", "regime", "annual_vol")


@query("A37 W8", sql("frame origins obs", _REGIME + """
SELECT predictor_id, regime, count(abs_error) AS n_resolved, round(avg(inside80), 6) AS coverage, round(avg(abs_error), 4) AS mae, round(avg(error), 4) AS mean_bias
FROM frame JOIN regimes USING (series_id, as_of) GROUP BY 1, 2"""))
def regime_error_report(spark: SparkSession, sf: str) -> DataFrame:
    obs, t, s = setup(spark, sf)
    o = bt.origin_table(t, s)
    f = an.aligned(bt.score_predictions(bt.resolve(bt.forecast_all(o, obs, FORECASTERS), obs, keep_unresolved=True), t))
    labelled = f.join(an.volatility_regime(o.select("series_id", "as_of"), obs).select("series_id", "as_of", "regime"), ["series_id", "as_of"])
    r = an.error_report(labelled, ("predictor_id", "regime")).select("predictor_id", "regime", "n_resolved", "coverage", "mae", "mean_bias")
    return rounded(rounded(r, 6, "coverage"), 4, "mae", "mean_bias")


@query("A37", sql("frame", """
, m AS (SELECT predictor_id, horizon, avg(abs_error) AS mae FROM frame GROUP BY 1, 2)
SELECT m.predictor_id, m.horizon, round(m.mae, 4) AS mae, round(b.mae, 4) AS baseline_mae, round(b.mae - m.mae, 4) AS mae_gain
FROM m JOIN m b ON b.horizon = m.horizon AND b.predictor_id = 'last_value_naive'"""))
def skill_against_baseline(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(an.skill_against(settled(frame(spark, sf), "frame"), "last_value_naive"), 4, "mae", "baseline_mae", "mae_gain")


@query("A38", sql("frame", """
, r AS (SELECT predictor_id, horizon, avg(inside80) AS c, avg(abs_error) AS m, avg(error) AS b FROM frame GROUP BY 1, 2),
f AS (SELECT predictor_id, arg_min(c, horizon) AS c0, arg_max(c, horizon) AS c1, arg_min(m, horizon) AS m0, arg_max(m, horizon) AS m1, bool_and(b > 0) OR bool_and(b < 0) AS bias_consistent FROM r GROUP BY 1)
SELECT predictor_id, CASE WHEN c1 < c0 - 0.05 THEN 'worsens' WHEN c1 > c0 + 0.05 THEN 'improves' ELSE 'flat' END AS coverage_trend,
  CASE WHEN m1 > m0 * 1.1 THEN 'increases' ELSE 'flat' END AS mae_trend, bias_consistent FROM f"""))
def horizon_trends(spark: SparkSession, sf: str) -> DataFrame:
    return an.horizon_trends(an.error_report(frame(spark, sf)))


@query("A39", sql("scored", """
, s AS (SELECT horizon, max(score) - min(score) AS spread FROM scored GROUP BY 1)
SELECT horizon, round(spread, 3) AS spread, spread = (SELECT max(spread) FROM s) AS decisive FROM s"""))
def decisive_horizon(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(an.decisive_horizon(settled(scored(spark, sf), "scored")), 3, "spread")


@query("A39", sql("scored", """
, b AS (SELECT predictor_id, avg(score) AS m, stddev_samp(score) / sqrt(count(*)) AS se FROM scored GROUP BY 1)
SELECT w.predictor_id AS winner, r.predictor_id AS runner_up, round(r.m - w.m, 4) AS gap, round(w.se + r.se, 4) AS noise, r.m - w.m > w.se + r.se AS significant
FROM b w JOIN b r ON r.m > w.m"""))
def winner_gap(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(an.winner_gap(scored(spark, sf)), 4, "gap", "noise")


@query("J16 A40", sql("scored", """
, d AS (SELECT a.horizon, a.score - b.score AS diff FROM scored a JOIN scored b ON a.task_id = b.task_id AND a.as_of = b.as_of AND a.horizon = b.horizon
  WHERE a.predictor_id = 'log_random_walk' AND b.predictor_id = 'last_value_naive')
SELECT horizon, count(*) AS n, round(avg(diff), 4) AS mean_diff, round(stddev_samp(diff) / sqrt(count(*)), 4) AS se, round(avg((diff < 0)::INT), 6) AS share_better FROM d GROUP BY 1"""))
def paired_test(spark: SparkSession, sf: str) -> DataFrame:
    """Paired score difference by horizon."""
    d = an.paired_differences(scored(spark, sf), "log_random_walk", "last_value_naive", ["task_id", "as_of", "horizon"])
    return rounded(rounded(an.paired_test(d, ["horizon"]), 4, "mean_diff", "se"), 6, "share_better")


@query("A41", sql("scored", """
, o AS (SELECT task_id, as_of, sum(score) AS s FROM scored GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY s DESC, as_of) AS k FROM o)
SELECT task_id, count(*) AS n_origins, round(sum(s) FILTER (WHERE k <= 3) / sum(s), 6) AS worst_share FROM r GROUP BY 1"""))
def score_concentration(spark: SparkSession, sf: str) -> DataFrame:
    """Share of the total score in the three worst origins of each task."""
    return rounded(an.concentration(settled(scored(spark, sf), "scored"), 3, ("task_id",)), 6, "worst_share")


@query("A41", sql("scored", """
, o AS (SELECT task_id, as_of, sum(score) AS s FROM scored GROUP BY 1, 2), w AS (SELECT task_id, arg_max(as_of, s) AS as_of FROM o GROUP BY 1)
SELECT task_id, predictor_id, round(avg(score), 4) AS mean_score, count(*) AS n FROM scored s WHERE NOT EXISTS (SELECT 1 FROM w WHERE w.task_id = s.task_id AND w.as_of = s.as_of) GROUP BY 1, 2"""))
def without_worst_origin(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(an.without_worst_origin(settled(scored(spark, sf), "scored"), ("task_id",)), 4, "mean_score")


@query("T3", sql("scored", "SELECT predictor_id, series_id, as_of, horizon, round(score, 3) AS score FROM scored ORDER BY scored.score DESC, predictor_id, series_id, as_of, horizon LIMIT 10"))
def worst_forecasts(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(an.worst_rows(scored(spark, sf), 10), 3, "score").select("predictor_id", "series_id", "as_of", "horizon", "score")


@query("J17", sql("scored", """
SELECT predictor_id, round(avg(score) FILTER (WHERE horizon = 5), 4) AS score_a, round(avg(score) FILTER (WHERE horizon = 21), 4) AS score_b,
  round(avg(score) FILTER (WHERE horizon = 21) - avg(score) FILTER (WHERE horizon = 5), 4) AS difference FROM scored GROUP BY 1"""))
def lead_comparison(spark: SparkSession, sf: str) -> DataFrame:
    """Leaderboards at the shortest and longest lead."""
    s = settled(scored(spark, sf), "scored")
    out = an.lead_comparison(an.leaderboard(s.filter("horizon = 5")), an.leaderboard(s.filter("horizon = 21")))
    return rounded(out, 4, "score_a", "score_b", "difference")


@query("T9", sql("scored", "SELECT task_id, arg_min(predictor_id, m) AS predictor_id, round(min(m), 4) AS mean_score FROM (SELECT task_id, predictor_id, avg(score) AS m FROM scored GROUP BY 1, 2) GROUP BY 1"))
def best_predictor_per_task(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(fc.best_per_task(an.leaderboard(scored(spark, sf), ("predictor_id", "task_id"))), 4, "mean_score")


@query("A50", sql("scored", """
SELECT predictor_id, task_id, count(ape) AS n, round(quantile_cont(ape, 0.0), 4) AS p0, round(quantile_cont(ape, 0.25), 4) AS p25, round(quantile_cont(ape, 0.5), 4) AS p50,
  round(quantile_cont(ape, 0.75), 4) AS p75, round(quantile_cont(ape, 1.0), 4) AS p100 FROM scored GROUP BY 1, 2"""))
def ape_distribution(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(an.ape_distribution(an.aligned(scored(spark, sf))), 4, "p0", "p25", "p50", "p75", "p100")


@query("W15", sql("scored", """
SELECT predictor_id, task_id, as_of, round(avg(score) OVER (PARTITION BY predictor_id, task_id ORDER BY as_of ROWS UNBOUNDED PRECEDING), 4) AS running_score FROM scored WHERE horizon = 5"""))
def running_mean_score(spark: SparkSession, sf: str) -> DataFrame:
    from tidemark.operators.features import running_mean

    s = settled(scored(spark, sf).filter("horizon = 5"), "scored")
    return rounded(running_mean(s, ["predictor_id", "task_id"], "as_of", "score", "running_score"), 4, "running_score").select("predictor_id", "task_id", "as_of", "running_score")


@query("J26", sql("frame obs", """
SELECT p.series_id, p.as_of, p.horizon, round(abs(p.point - a.value), 5) AS walk_error, round(abs(n.point - a.value), 5) AS naive_error
FROM frame p JOIN frame n ON n.task_id = p.task_id AND n.as_of = p.as_of AND n.horizon = p.horizon AND n.predictor_id = 'last_value_naive'
ASOF JOIN obs a ON a.series_id = p.series_id AND p.forecast_date <= a.timestamp WHERE p.predictor_id = 'log_random_walk'"""))
def trajectory_comparison(spark: SparkSession, sf: str) -> DataFrame:
    """Two trajectories at each origin and horizon against the first session at or after the target date."""
    obs, t, s = setup(spark, sf)
    p = settled(bt.forecast_all(bt.origin_table(t, s), obs, FORECASTERS), "predictions")
    pick = lambda n: F.max(F.when(F.col("predictor_id") == n, F.col("point")))
    both = p.groupBy("series_id", "as_of", "horizon", "forecast_date").agg(pick("log_random_walk").alias("_w"), pick("last_value_naive").alias("_n"))
    seen = asof.value_at_or_after(both, obs, "forecast_date", "_v").filter(F.col("_v").isNotNull())
    a = F.col("_v.value")
    return seen.select("series_id", "as_of", "horizon", F.round(F.abs(F.col("_w") - a), 5).alias("walk_error"), F.round(F.abs(F.col("_n") - a), 5).alias("naive_error"))


@query("J27", sql("origins obs", """
SELECT o.series_id, o.as_of, h.horizon, a.value AS actual FROM origins o, (SELECT unnest([5, 10, 21]) AS horizon) h
JOIN obs a ON a.series_id = o.series_id AND a.timestamp = o.as_of + to_days(h.horizon)"""))
def actuals_by_origin_and_horizon(spark: SparkSession, sf: str) -> DataFrame:
    obs, t, s = setup(spark, sf)
    return bt.resolve(fc.horizons_of(bt.origin_table(t, s)), obs).select("series_id", "as_of", "horizon", "actual")


# --- direction and probability tables --------------------------------------------------------------


def _return_task(spark: SparkSession, sf: str):
    """Daily log returns of prices as the target of a last-value and a zero-drift style forecast."""
    from tidemark.operators import features as ft

    obs = settled(ft.cumulative_log_returns(prices(spark, sf), (1, 5)), "returns")
    t = tasks(obs.select("series_id"), horizons=(1, 5), frequency="B")
    return obs, t, specs(t, spec_id="returns", start="1996-01-01", stride=10, warmup=30)


_RETURNS = """
, r AS (SELECT series_id || '_' || k || 'b' AS series_id, timestamp, ln(value / p) AS value, timestamp AS released_at FROM (
  SELECT series_id, timestamp, value, unnest([1, 5]) AS k, unnest([lag(value, 1) OVER w, lag(value, 5) OVER w]) AS p FROM prices WINDOW w AS (PARTITION BY series_id ORDER BY timestamp)) WHERE p IS NOT NULL),
g AS (SELECT d AS as_of FROM (SELECT d, row_number() OVER (ORDER BY d) - 1 AS i FROM unnest(generate_series(TIMESTAMP '1996-01-01', TIMESTAMP '2001-06-30', INTERVAL 1 DAY)) t(d) WHERE isodow(d) < 6) WHERE i % 10 = 0),
n AS (SELECT *, count(*) OVER (PARTITION BY series_id ORDER BY timestamp) AS k FROM r),
f AS (SELECT n.series_id, g.as_of, h.horizon, n.value AS point, g.as_of + to_days(CAST(CASE WHEN isodow(g.as_of) - 1 + h.horizon > 4 THEN h.horizon + 2 ELSE h.horizon END AS INTEGER)) AS forecast_date
  FROM (SELECT s.series_id, g.as_of FROM g, (SELECT DISTINCT series_id FROM r) s) g ASOF JOIN n ON n.series_id = g.series_id AND g.as_of >= n.timestamp, (SELECT unnest([1, 5]) AS horizon) h WHERE n.k >= 30),
d AS (SELECT f.series_id, f.as_of, f.horizon, f.point, r.value AS actual, (r.value > 0)::INT AS y, (f.point > 0)::INT AS p, CASE WHEN f.point > 0 THEN 1.0 ELSE 0.0 END AS s
  FROM f JOIN r ON r.series_id = f.series_id AND r.timestamp = f.forecast_date)"""


@query("A22 F9 J4", sql("prices", _RETURNS + " SELECT series_id, as_of, horizon, actual > 0 AS up, point > 0 AS called_up, CASE WHEN point > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS prob_up FROM d"))
def prob_up_from_quantiles(spark: SparkSession, sf: str) -> DataFrame:
    """P(return > 0) from quantiles; a point mass clamps to its end of the CDF."""
    obs, t, s = _return_task(spark, sf)
    d = an.direction_frame(bt.backtest(obs, t, s, {"n": fc.last_value}))
    return d.select("series_id", "as_of", "horizon", (F.col("actual_up") == 1).alias("up"), (F.col("pred_up") == 1).alias("called_up"), F.round("prob_up", 6).alias("prob_up"))


_METRICS = """
, c AS (SELECT {key}, count(*) AS n, count(*) FILTER (WHERE y = 1 AND p = 1) AS tp, count(*) FILTER (WHERE y = 0 AND p = 1) AS fp, count(*) FILTER (WHERE y = 1 AND p = 0) AS fn, count(*) FILTER (WHERE y = 0 AND p = 0) AS tn FROM {src} GROUP BY 1),
k AS (SELECT {key}, y, avg(rk) AS mr, count(*) AS ny FROM (SELECT {key}, y, rank() OVER (PARTITION BY {key} ORDER BY s) + (count(*) OVER (PARTITION BY {key}, s) - 1) / 2.0 AS rk FROM {src}) GROUP BY 1, 2)
SELECT c.{key}, c.n, tp, fp, fn, tn, round((tp + fn) / c.n, 6) AS prevalence_up, round((tp + tn) / c.n, 6) AS accuracy,
  round((tp / (tp + fn) + tn / (tn + fp)) / 2, 6) AS balanced_accuracy,
  round(CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END, 6) AS precision_up, round(tp / (tp + fn), 6) AS recall_up, round(2 * tp / (2 * tp + fp + fn), 6) AS f1_up,
  round(CASE WHEN tn + fn > 0 THEN tn / (tn + fn) ELSE 0 END, 6) AS precision_down, round(tn / (tn + fp), 6) AS recall_down, round(2 * tn / (2 * tn + fp + fn), 6) AS f1_down,
  round(CASE WHEN (tp + fp) * (tn + fn) > 0 THEN (tp::DOUBLE * tn - fp::DOUBLE * fn) / sqrt((tp + fp)::DOUBLE * (tp + fn) * (tn + fp) * (tn + fn)) ELSE 0 END, 6) AS matthews_corrcoef,
  round(((tp + tn) / c.n - e) / (1 - e), 6) AS cohen_kappa, round(greatest((tp + fn) / c.n, (tn + fp) / c.n), 6) AS majority_baseline,
  round((a.mr * a.ny - a.ny * (a.ny + 1) / 2.0) / (a.ny * b.ny), 6) AS roc_auc
FROM (SELECT *, ((tp + fp)::DOUBLE * (tp + fn) + (tn + fn)::DOUBLE * (tn + fp)) / (n::DOUBLE * n) AS e FROM c) c JOIN k a ON a.{key} = c.{key} AND a.y = 1 JOIN k b ON b.{key} = c.{key} AND b.y = 0"""
_METRIC_NAMES = ("prevalence_up accuracy balanced_accuracy precision_up recall_up f1_up precision_down recall_down f1_down matthews_corrcoef cohen_kappa majority_baseline roc_auc").split()


@query("A21 A10", sql("prices", _RETURNS + _METRICS.format(key="series_id", src="d")))
def direction_metrics(spark: SparkSession, sf: str) -> DataFrame:
    obs, t, s = _return_task(spark, sf)
    d = settled(an.direction_frame(bt.backtest(obs, t, s, {"n": fc.last_value})).select("series_id", "actual_up", "pred_up", "prob_up"), "direction")
    return rounded(an.binary_metrics(d, ["series_id"]), 6, *_METRIC_NAMES)


@query("A21", "WITH d AS (SELECT l.quality AS y, (d.n_chars > 1000)::INT AS p, CAST(d.n_chars AS DOUBLE) AS s, d.lang FROM labels l JOIN documents d USING (doc_id))" + _METRICS.format(key="lang", src="d"))
def label_metrics(spark: SparkSession, sf: str) -> DataFrame:
    """The same metrics for a length score against stored quality labels, per language."""
    j = table(spark, sf, "labels").join(table(spark, sf, "documents"), "doc_id").select(
        "lang", F.col("quality").alias("actual_up"), (F.col("n_chars") > 1000).cast("int").alias("pred_up"), F.col("n_chars").cast("double").alias("prob_up")
    )
    return rounded(an.binary_metrics(j, ["lang"]), 6, *_METRIC_NAMES)


@query("A10 T6", sql("prices", _RETURNS + """
SELECT 'last_value_naive' AS predictor_id, 'next_' || series_id AS task_id, 5 AS horizon, round(avg(abs(point - actual)), 6) AS mean_crps, count(*) AS n_scores, round(avg((y = p)::INT), 6) AS dir_accuracy,
  2::BIGINT AS n_covariates, true AS uses_covariates, 'oil, rates' AS covariates FROM d GROUP BY series_id ORDER BY mean_crps NULLS LAST"""))
def direction_leaderboard(spark: SparkSession, sf: str) -> DataFrame:
    """Scores with direction accuracy and covariate columns, ordered by horizon and score."""
    obs, t, s = _return_task(spark, sf)
    cov = spark.createDataFrame([("last_value_naive", "rates"), ("last_value_naive", "oil")], "predictor_id string, covariate string")
    board = an.direction_leaderboard(settled(bt.backtest(obs, t, s, {"n": fc.last_value}), "scored"), F.broadcast(cov))
    out = rounded(board, 6, "mean_crps", "dir_accuracy").select(
        "predictor_id", "task_id", "horizon", "mean_crps", "n_scores", "dir_accuracy", "n_covariates", "uses_covariates", "covariates"
    )
    return out.orderBy("horizon", F.asc_nulls_last("mean_crps"))


def _categorical(spark: SparkSession, sf: str) -> DataFrame:
    obs, t, s = decision_setup(spark, sf)
    out = bt.backtest(obs, t, s, {"cf": lambda c, o: fc.category_frequency(c, o, DIRECTIONS)})
    return out.withColumn("outcome_label", sc.category_label(F.col("categories"), F.col("actual")))


_OVR = """
, ovr AS (SELECT series_id, forecast_date, unnest(['down', 'same', 'up']) AS label, unnest([p_down, p_same, p_up]) AS probability,
  unnest([(actual = -1)::INT, (actual = 0)::INT, (actual = 1)::INT])::DOUBLE AS outcome FROM probs)"""


@query("P18", sql("decisions", _DECISION_PROBS + _OVR + " SELECT series_id, forecast_date, label, round(probability, 8) AS probability, outcome FROM ovr"))
def one_vs_rest(spark: SparkSession, sf: str) -> DataFrame:
    """Every category's binary view of the categorical forecasts."""
    o = sc.one_vs_rest(_categorical(spark, sf), F.col("categories"))
    return o.select("series_id", "forecast_date", "label", F.round("probability", 8).alias("probability"), "outcome")


@query("A18", sql("decisions", _DECISION_PROBS + _OVR + """
, e AS (SELECT unnest([0.0, 0.2, 0.4, 0.6000000000000001, 0.8]::DOUBLE[]) AS l, unnest([0.2, 0.4, 0.6000000000000001, 0.8, 1.0]::DOUBLE[]) AS r)
SELECT label, l AS bin_left, r AS bin_right, round(avg(probability), 8) AS mean_predicted, round(avg(outcome), 8) AS observed_frequency, count(*) AS n
FROM ovr JOIN e ON probability >= l AND (probability < r OR (r = 1 AND probability <= r)) GROUP BY 1, 2, 3"""))
def calibration(spark: SparkSession, sf: str) -> DataFrame:
    """Reliability bins per category."""
    o = sc.one_vs_rest(_categorical(spark, sf), F.col("categories"))
    return rounded(an.calibration(o, 5, ("label",)), 8, "mean_predicted", "observed_frequency")


@query("A19", sql("decisions", """
SELECT series_id, CAST(year(timestamp) AS INTEGER) AS year, count(*) AS n_events, count(*) FILTER (WHERE value = -1) AS n_down, count(*) FILTER (WHERE value = 1) AS n_up,
  round(count(*) FILTER (WHERE value = -1) / count(*), 3) AS down_rate FROM decisions GROUP BY 1, 2"""))
def yearly_outcomes(spark: SparkSession, sf: str) -> DataFrame:
    return an.yearly_outcomes(decisions(spark, sf), {"down": -1.0, "up": 1.0}, "down")


@query("A20", sql("decisions", "SELECT series_id, value, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY series_id), 8) AS share FROM decisions GROUP BY 1, 2"))
def class_shares(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(an.class_shares(decisions(spark, sf), "value", ("series_id",)), 8, "share")


@query("J24 T7 W18", sql("decisions", _DECISION_PROBS + """
, last AS (SELECT series_id, max(forecast_date) AS d FROM probs GROUP BY 1), pr AS (SELECT series_id, timestamp, lag(value) OVER (PARTITION BY series_id ORDER BY timestamp) AS v FROM decisions)
SELECT p.series_id, p.forecast_date, round(p.p_up, 8) AS p_up, CASE p.actual WHEN -1 THEN 'down' WHEN 0 THEN 'same' ELSE 'up' END AS outcome_label,
  CASE pr.v WHEN -1 THEN 'down' WHEN 0 THEN 'same' WHEN 1 THEN 'up' END AS prior_outcome_label
FROM probs p JOIN last l ON l.series_id = p.series_id AND l.d = p.forecast_date JOIN pr ON pr.series_id = p.series_id AND pr.timestamp = p.forecast_date"""))
def newest_event_panel(spark: SparkSession, sf: str) -> DataFrame:
    """The latest event of each series: distribution, outcome and the outcome before."""
    obs, t, s = decision_setup(spark, sf)
    p = bt.forecast_all(bt.origin_table(t, s), obs, {"cf": lambda c, o: fc.category_frequency(c, o, DIRECTIONS)})
    resolved = p.join(obs.select("series_id", F.col("timestamp").alias("forecast_date")), ["series_id", "forecast_date"], "left_semi")
    panel = an.event_panel(settled(resolved, "panel"), obs, category_column())
    return panel.select("series_id", "forecast_date", F.round(F.col("probs")["up"], 8).alias("p_up"), "outcome_label", "prior_outcome_label")


@query("A23", sql("monthly", """
, vis AS (SELECT o.series_id, o.as_of, arg_max(m.value, m.timestamp) AS v, count(*) AS n FROM (SELECT s.series_id, y.as_of FROM (SELECT DISTINCT series_id FROM monthly) s,
    (SELECT unnest([TIMESTAMP '1996-07-01', TIMESTAMP '1997-07-01', TIMESTAMP '1998-07-01', TIMESTAMP '1999-07-01', TIMESTAMP '2000-07-01']) AS as_of) y) o JOIN monthly m ON m.series_id = o.series_id AND m.released_at <= o.as_of GROUP BY 1, 2),
yr AS (SELECT series_id, year(timestamp) AS y, avg(value) AS a, count(*) AS n FROM monthly GROUP BY 1, 2)
SELECT vis.series_id, vis.as_of, CAST(year(vis.as_of) AS INTEGER) AS origin_year, round(y0.a, 7) AS actual_avg_y0, round(v / y0.a - 1, 8) AS yoy_median,
  round(v / y0.a - 1, 8) AS yoy_q25, CASE WHEN y1.n = 12 THEN round(y1.a / y0.a - 1, 8) END AS actual_yoy
FROM vis JOIN yr y0 ON y0.series_id = vis.series_id AND y0.y = year(vis.as_of) AND y0.n >= 12 LEFT JOIN yr y1 ON y1.series_id = vis.series_id AND y1.y = year(vis.as_of) + 1"""))
def average_yoy(spark: SparkSession, sf: str) -> DataFrame:
    """Next calendar year's average against this year's, from July origins on monthly series."""
    m = settled(monthly(spark, sf), "monthly")
    t = tasks(m.select("series_id"), horizons=tuple(range(6, 18)), frequency="MS")
    s = specs(t, spec_id="july", start="1996-07-01", end="2000-12-31", stride=12, warmup=1)
    p = bt.forecast_all(bt.origin_table(t, s), m, {"n": fc.last_value})
    out = an.average_yoy(p, m)
    return rounded(rounded(out, 8, "yoy_median", "yoy_q25", "actual_yoy"), 7, "actual_avg_y0").select(
        "series_id", "as_of", "origin_year", "actual_avg_y0", "yoy_median", "yoy_q25", "actual_yoy"
    )


@query("A52 T9 A23", sql("monthly", """
, js AS (SELECT unnest([TIMESTAMP '1996-07-01', TIMESTAMP '1997-07-01', TIMESTAMP '1998-07-01', TIMESTAMP '1999-07-01', TIMESTAMP '2000-07-01']) AS as_of),
r AS (SELECT *, ln(value / lag(value) OVER w) AS r, row_number() OVER w AS n, first_value(timestamp) OVER w AS t0 FROM monthly WINDOW w AS (PARTITION BY series_id ORDER BY timestamp)),
vis AS (SELECT r.series_id, js.as_of, arg_max(value, timestamp) AS v, sum(r) / date_diff('month', min(t0), max(timestamp)) AS mu FROM js JOIN r ON r.released_at <= js.as_of GROUP BY 1, 2),
p AS (SELECT series_id, as_of, h, as_of + to_months(h) AS forecast_date, predictor_id, CASE predictor_id WHEN 'last_value_naive' THEN v ELSE exp(ln(v) + h * mu) END AS point
  FROM vis, (SELECT unnest(range(6, 18))::INTEGER AS h), (SELECT unnest(['last_value_naive', 'log_random_walk']) AS predictor_id)),
sc AS (SELECT p.*, abs(p.point - m.value) AS naive_score, m.value AS actual FROM p JOIN monthly m ON m.series_id = p.series_id AND m.timestamp = p.forecast_date),
yr AS (SELECT series_id, year(timestamp) AS y, avg(value) AS a, count(*) AS n FROM monthly GROUP BY 1, 2)
SELECT p.predictor_id, count(DISTINCT p.as_of) AS n_origins, round(avg(yoy), 6) AS mean_yoy FROM (
  SELECT p.series_id, p.as_of, p.predictor_id, avg(p.point) / any_value(y0.a) - 1 AS yoy FROM p JOIN yr y0 ON y0.series_id = p.series_id AND y0.y = year(p.as_of) AND y0.n >= 12
  WHERE year(p.forecast_date) = year(p.as_of) + 1 GROUP BY 1, 2, 3) p GROUP BY 1"""))
def yoy_of_each_predictor(spark: SparkSession, sf: str) -> DataFrame:
    """Average-over-average change averaged over origins and series, per predictor."""
    p, m, _ = _july(spark, sf)
    out = an.average_yoy(p, m)
    return out.groupBy("predictor_id").agg(F.countDistinct("as_of").alias("n_origins"), F.round(F.avg("yoy_median"), 6).alias("mean_yoy"))


@query("A52 T9")
def yoy_of_best_predictor(spark: SparkSession, sf: str) -> DataFrame:
    """Window-average change band of each task's best-scoring predictor."""
    p, m, t = _july(spark, sf)
    best = fc.best_per_task(an.leaderboard(bt.score_predictions(bt.resolve(p, m), t), ("predictor_id", "task_id")))
    yoy = an.average_yoy(p, m).join(best.select("task_id", "predictor_id"), ["task_id", "predictor_id"])
    band = ("yoy_q05", "yoy_q25", "yoy_median", "yoy_q75", "yoy_q95")
    return yoy.groupBy("task_id", "predictor_id").agg(F.count(F.lit(1)).alias("n_origins"), *[F.round(F.avg(c), 6).alias(c) for c in band])


def _july(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    m = settled(monthly(spark, sf), "monthly")
    t = tasks(m.select("series_id"), horizons=tuple(range(6, 18)), frequency="MS")
    s = specs(t, spec_id="july", start="1996-07-01", end="2000-12-31", stride=12, warmup=1)
    return settled(bt.forecast_all(bt.origin_table(t, s), m, FORECASTERS), "july"), m, t


@query("A46 U6", "SELECT event_id, 'k' AS key, json_extract_string(props, '$.k') AS value FROM events")
def metadata_long(spark: SparkSession, sf: str) -> DataFrame:
    return an.metadata_long(table(spark, sf, "events"), ["event_id"], "props")


@query("A46", "SELECT event_id, json_extract_string(props, '$.k') AS meta_k, CAST(NULL AS VARCHAR) AS meta_note FROM events")
def metadata_wide(spark: SparkSession, sf: str) -> DataFrame:
    return an.metadata_wide(table(spark, sf, "events"), ["event_id"], ["k", "note"], "props")


@query("A43", "SELECT event_type AS predictor_id, round(sum(value), 4) AS total_usd, round(avg(value), 6) AS mean_usd, round(avg(length(props)), 6) AS mean_latency_s, CAST(max(length(props)) AS INTEGER) AS max_latency_s, count(*) AS n FROM events GROUP BY 1")
def cost_latency(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").select(F.col("event_type").alias("predictor_id"), F.col("value").alias("cost_usd"), F.length("props").alias("latency_s"))
    return rounded(rounded(an.cost_latency(e), 4, "total_usd"), 6, "mean_usd", "mean_latency_s")


@query("P20", """
SELECT event_id, CASE WHEN event_type || '_' || user_id IN ('click_1') OR starts_with(event_type || '_' || user_id, 'click_1_') THEN 'Special' WHEN starts_with(event_type || '_' || user_id, 'click_') THEN 'Clicks'
  WHEN starts_with(event_type || '_' || user_id, 'error_') THEN 'Errors' ELSE replace(event_type || '_' || user_id, '_', ' ') END AS arm FROM events""")
def arm_labels(spark: SparkSession, sf: str) -> DataFrame:
    """Longest known prefix decides the label."""
    e = table(spark, sf, "events").select("event_id", F.concat_ws("_", "event_type", F.col("user_id").cast("string")).alias("name"))
    return an.longest_prefix_label(e, "name", {"click": "Clicks", "click_1": "Special", "error": "Errors"}).select("event_id", "arm")


def _gaps_sql(release: str) -> str:
    return sql("origins prices", f"""
, late AS (SELECT series_id, timestamp, {release} AS released_at FROM prices),
o AS (SELECT DISTINCT p.series_id, og.as_of FROM origins og, (SELECT DISTINCT series_id FROM prices) p),
vis AS (SELECT o.series_id, o.as_of, p.timestamp, row_number() OVER (PARTITION BY o.series_id, o.as_of ORDER BY p.timestamp DESC) AS r FROM o JOIN late p ON p.series_id = o.series_id AND p.released_at <= o.as_of),
w AS (SELECT series_id, as_of, max(timestamp) AS last_at, min(timestamp) AS from_at FROM vis WHERE r <= 8 GROUP BY 1, 2),
grid AS (SELECT w.series_id, w.as_of, d FROM w, unnest(generate_series(w.from_at, w.last_at, INTERVAL 1 DAY)) t(d) WHERE isodow(d) < 6),
cal AS (SELECT g.series_id, g.as_of, max(d) AS missing FROM grid g LEFT JOIN vis v ON v.series_id = g.series_id AND v.as_of = g.as_of AND v.timestamp = g.d AND v.r <= 8 WHERE v.r IS NULL GROUP BY 1, 2)
SELECT w.series_id, w.as_of, c.missing AS nearest_missing FROM w LEFT JOIN cal c ON c.series_id = w.series_id AND c.as_of = w.as_of""")


def _gaps(spark: SparkSession, sf: str, release=None) -> DataFrame:
    p = prices(spark, sf)
    p = settled(p if release is None else p.withColumn("released_at", release), "prices")
    grid = cal.every_nth(cal.calendar_grid(cal.ntz(START), cal.ntz(END), "D"), STRIDE)
    probes = p.select("series_id").distinct().withColumn("as_of", F.explode(grid))
    return an.gap_positions(probes, p, 8).filter(F.col("last_value").isNotNull()).select("series_id", "as_of", "nearest_missing")


@query("A44 C7", _gaps_sql("released_at"))
def gap_positions(spark: SparkSession, sf: str) -> DataFrame:
    """The nearest missing business day in the last eight visible sessions before each origin."""
    return _gaps(spark, sf)


@query("A44 C7", _gaps_sql("CASE WHEN day(timestamp) % 9 = 0 THEN released_at + INTERVAL 10 DAY ELSE released_at END"))
def gaps_of_late_sessions(spark: SparkSession, sf: str) -> DataFrame:
    """The same where some sessions come out ten days late: until then their day is missing."""
    late = F.dayofmonth("timestamp") % 9 == 0
    return _gaps(spark, sf, F.when(late, cal.plus_days("released_at", 10)).otherwise(F.col("released_at")))


@query("A51", """
, x AS (SELECT 1) SELECT 1""".replace(", x AS (SELECT 1) SELECT 1", """
WITH q AS (SELECT l_returnflag AS series_id, l_linenumber AS contract, arg_max(l_extendedprice, (l_shipdate, l_orderkey, l_partkey, l_suppkey, l_extendedprice)) AS close FROM lineitem GROUP BY 1, 2)
SELECT series_id, round(arg_min(close, contract), 4) AS near, round(arg_max(close, contract), 4) AS far, count(*) AS n_contracts, count(*) > 1 AND arg_max(close, contract) > arg_min(close, contract) AS contango FROM q GROUP BY 1"""))
def term_structure(spark: SparkSession, sf: str) -> DataFrame:
    """Last quote per contract and whether the far one trades above the near one (line number as expiry)."""
    q = table(spark, sf, "lineitem").select(
        F.col("l_returnflag").alias("series_id"), F.col("l_linenumber").alias("contract"), F.col("l_linenumber").alias("expiry"), F.col("l_extendedprice").alias("close"),
        F.struct("l_shipdate", "l_orderkey", "l_partkey", "l_suppkey", "l_extendedprice").alias("timestamp"),
    )
    return rounded(an.term_structure(q), 4, "near", "far")


@query("P25 A42", """
WITH j AS (SELECT d.lang, (l.quality = 1) AS ok, (d.n_chars > 1000) AS al, d.n_chars FROM labels l JOIN documents d USING (doc_id))
SELECT lang AS predictor_id, count(*) AS n, round(avg(al::INT), 6) AS mean_alignment, count(*) FILTER (WHERE ok AND al) AS n_right_right FROM j GROUP BY 1""")
def alignment_summary(spark: SparkSession, sf: str) -> DataFrame:
    """Right for the right reasons: outcome label against a stored verdict."""
    j = table(spark, sf, "labels").join(table(spark, sf, "documents"), "doc_id")
    rows = j.select(
        F.col("lang").alias("predictor_id"), (F.col("n_chars") > 1000).cast("double").alias("alignment"),
        an.alignment_label(F.col("quality") == 1, F.col("n_chars") > 1000).alias("quadrant"),
    )
    return rounded(an.alignment_summary(rows), 6, "mean_alignment")


