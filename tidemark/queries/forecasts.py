"""As-of views and forecasters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.functions import calendar as cal, scoring as sc
from tidemark.operators import asof, features as ft, forecast as fc
from tidemark.plans import backtest as bt
from tidemark.queries.registry import query
from tidemark.session import settled
from tidemark.queries.tables import (
    DIRECTIONS, END, FORECASTERS, START, WARMUP, Z_LIST, announcements, category_column, cte, decisions, monthly, monthly_origins, observations, prices,
    rounded, setup, specs, sql, step_rates, table, tasks,
)

KEY = ["series_id"]


# --- as-of views -----------------------------------------------------------------------------


@query("P1 P2", sql("obs", "SELECT series_id, timestamp, value, released_at FROM obs WHERE coalesce(released_at, timestamp) <= TIMESTAMP '1998-06-30'"))
def cutoff_filter(spark: SparkSession, sf: str) -> DataFrame:
    """Rows released by one inclusive cutoff."""
    return asof.as_of(observations(spark, sf), "1998-06-30")


@query("P1", sql("obs", """
SELECT series_id, count(*) AS n FROM (SELECT series_id, timestamp, CASE WHEN day(timestamp) % 2 = 0 THEN released_at END AS released_at FROM obs)
WHERE coalesce(released_at, timestamp) <= TIMESTAMP '1998-06-30' GROUP BY 1"""))
def cutoff_null_release(spark: SparkSession, sf: str) -> DataFrame:
    """A missing release falls back to the row's own stamp."""
    half = observations(spark, sf).withColumn("released_at", F.when(F.dayofmonth("timestamp") % 2 == 0, F.col("released_at")))
    return asof.as_of(half, "1998-06-30").groupBy("series_id").agg(F.count(F.lit(1)).alias("n"))


@query("J1 T1 P2", sql("monthly_origins obs", """
SELECT m.series_id, m.as_of, count(o.timestamp) AS n_visible, arg_max(o.value, o.timestamp) AS last_value, max(o.timestamp) AS last_at
FROM monthly_origins m LEFT JOIN obs o ON o.series_id = m.series_id AND o.released_at <= m.as_of GROUP BY 1, 2"""))
def visible_state(spark: SparkSession, sf: str) -> DataFrame:
    """Visible rows and the latest visible value at every monthly origin."""
    out = asof.visible_state(monthly_origins(spark, sf), observations(spark, sf))
    return out.select("series_id", "as_of", "n_visible", F.col("last.value").alias("last_value"), F.col("last.at").alias("last_at"))


_LATE = "(SELECT series_id, timestamp, value, timestamp + to_days(CAST(10 + day(timestamp) * 37 % 60 AS INTEGER)) AS released_at FROM obs)"


@query("J1 T1", sql("monthly_origins obs", f"""
SELECT m.series_id, m.as_of, count(o.timestamp) AS n_visible, arg_max(o.value, o.timestamp) AS last_value, max(o.timestamp) AS last_at
FROM monthly_origins m LEFT JOIN {_LATE} o ON o.series_id = m.series_id AND o.released_at <= m.as_of GROUP BY 1, 2"""))
def visible_out_of_order(spark: SparkSession, sf: str) -> DataFrame:
    """The same when releases arrive out of stamp order."""
    late = observations(spark, sf).withColumn("released_at", cal.plus_days("timestamp", F.lit(10) + F.dayofmonth("timestamp") * 37 % 60))
    out = asof.visible_state(monthly_origins(spark, sf), late)
    return out.select("series_id", "as_of", "n_visible", F.col("last.value").alias("last_value"), F.col("last.at").alias("last_at"))


@query("W11 A47", sql("monthly_origins obs", f"""
SELECT series_id, as_of, rank, timestamp, value FROM (
  SELECT m.series_id, m.as_of, o.timestamp, o.value, row_number() OVER (PARTITION BY m.series_id, m.as_of ORDER BY o.timestamp DESC) AS rank
  FROM monthly_origins m JOIN {_LATE} o ON o.series_id = m.series_id AND o.released_at <= m.as_of) WHERE rank <= 20"""))
def trailing_visible(spark: SparkSession, sf: str) -> DataFrame:
    """The 20 latest visible rows at every origin, releases out of order."""
    late = observations(spark, sf).withColumn("released_at", cal.plus_days("timestamp", F.lit(10) + F.dayofmonth("timestamp") * 37 % 60))
    out = asof.trailing_visible(monthly_origins(spark, sf), late, 20)
    return out.select("series_id", "as_of", F.col("rank").cast("long").alias("rank"), "timestamp", "value")


@query("J5 J28", sql("announcements rates", """
SELECT a.series_id, a.announced_at, r.value AS level, r.timestamp AS level_at
FROM announcements a ASOF LEFT JOIN rates r ON a.series_id = r.series_id AND a.announced_at >= r.timestamp"""))
def level_in_force(spark: SparkSession, sf: str) -> DataFrame:
    """Policy level at or just before each event (as-of backward, inclusive)."""
    out = asof.value_at_or_before(announcements(spark, sf), step_rates(spark, sf), "announced_at", "_v")
    return out.select("series_id", "announced_at", F.col("_v.value").alias("level"), F.col("_v.at").alias("level_at"))


@query("J6 H8", sql("decisions", "SELECT series_id, timestamp, value, released_at FROM decisions"))
def decision_outcomes(spark: SparkSession, sf: str) -> DataFrame:
    """Direction of each decision from the values strictly before and after it."""
    return decisions(spark, sf)


@query("J7 H8 W9", sql("rates announcements", """
SELECT c.series_id, c.timestamp, c.value, c.previous
FROM (SELECT *, lag(value) OVER (PARTITION BY series_id ORDER BY timestamp) AS previous FROM rates) c
JOIN (SELECT series_id, min(announced_at) AS lo, max(announced_at) + INTERVAL 7 DAY AS hi FROM announcements WHERE kind = 'scheduled' GROUP BY 1) s
  ON s.series_id = c.series_id AND c.timestamp BETWEEN s.lo AND s.hi
WHERE c.previous IS NOT NULL AND c.value <> c.previous
  AND NOT EXISTS (SELECT 1 FROM announcements a WHERE a.kind = 'scheduled' AND a.series_id = c.series_id AND a.announced_at <= c.timestamp AND c.timestamp <= a.announced_at + INTERVAL 7 DAY)"""))
def unexplained_changes(spark: SparkSession, sf: str) -> DataFrame:
    """Level changes with no scheduled announcement in the week before (range anti join)."""
    from tidemark.operators import events as ev

    return ev.unexplained_changes(step_rates(spark, sf), announcements(spark, sf, "scheduled")).select("series_id", "timestamp", "value", "previous")


@query("J8", sql("monthly_origins obs", """
SELECT m.series_id, m.as_of, o.timestamp AS session, o.value
FROM monthly_origins m ASOF LEFT JOIN obs o ON m.series_id = o.series_id AND m.as_of <= o.timestamp"""))
def first_session_at_or_after(spark: SparkSession, sf: str) -> DataFrame:
    out = asof.value_at_or_after(monthly_origins(spark, sf), observations(spark, sf), "as_of", "_v")
    return out.select("series_id", "as_of", F.col("_v.at").alias("session"), F.col("_v.value").alias("value"))


@query("J10", sql("announcements obs", """
SELECT a.series_id, a.announced_at, o.timestamp AS session
FROM announcements a ASOF LEFT JOIN obs o ON a.series_id = o.series_id AND a.announced_at < o.timestamp"""))
def next_session_after(spark: SparkSession, sf: str) -> DataFrame:
    """First session strictly after each announcement."""
    out = asof.value_at_or_after(announcements(spark, sf), observations(spark, sf), "announced_at", "_v", inclusive=False)
    return out.select("series_id", "announced_at", F.col("_v.at").alias("session"))


@query("J21 J19", sql("monthly_origins announcements", """
SELECT m.series_id, m.as_of, a.announced_at FROM monthly_origins m JOIN announcements a
ON a.series_id = m.series_id AND m.as_of BETWEEN a.announced_at AND a.announced_at + INTERVAL 3 DAY"""))
def stale_origins(spark: SparkSession, sf: str) -> DataFrame:
    """Origins inside a blackout window after an announcement (a range join on time buckets)."""
    from tidemark.operators import events as ev

    blackout = announcements(spark, sf).withColumn("hi", cal.plus_days("announced_at", 3)).drop("kind")
    return ev.stale_origins(monthly_origins(spark, sf), blackout, "announced_at", "hi").select("series_id", "as_of", "announced_at")


@query("J19", sql("monthly_origins announcements", """
SELECT m.series_id, m.as_of FROM monthly_origins m WHERE NOT EXISTS (
  SELECT 1 FROM announcements a WHERE a.series_id = m.series_id AND m.as_of BETWEEN a.announced_at - INTERVAL 3 DAY AND a.announced_at + INTERVAL 3 DAY)"""))
def outside_exclusion_zones(spark: SparkSession, sf: str) -> DataFrame:
    zones = announcements(spark, sf).select("series_id", cal.plus_days("announced_at", -3).alias("lo"), cal.plus_days("announced_at", 3).alias("hi"))
    return asof.outside_all_spans(monthly_origins(spark, sf), zones, "as_of", "lo", "hi", KEY)


@query("A49 J1", sql("monthly_origins obs monthly", """
SELECT d.as_of, d.n, d.daily_sum, m.monthly_sum FROM (
  SELECT as_of, count(*) AS n, round(sum(v), 5) AS daily_sum FROM (SELECT m.as_of, m.series_id, arg_max(o.value, o.timestamp) AS v FROM monthly_origins m JOIN obs o ON o.series_id = m.series_id AND o.released_at <= m.as_of GROUP BY 1, 2) GROUP BY 1) d
LEFT JOIN (SELECT as_of, round(sum(v), 5) AS monthly_sum FROM (SELECT m.as_of, m.series_id, arg_max(o.value, o.timestamp) AS v FROM monthly_origins m JOIN monthly o ON o.series_id = m.series_id AND o.released_at <= m.as_of GROUP BY 1, 2) GROUP BY 1) m USING (as_of)"""))
def covariate_snapshot(spark: SparkSession, sf: str) -> DataFrame:
    """Last visible value of every daily and monthly covariate at each origin."""
    o = monthly_origins(spark, sf)
    day = asof.visible_state(o, observations(spark, sf)).filter("last is not null").groupBy("as_of").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("last.value"), 5).alias("daily_sum")
    )
    month = asof.visible_state(o, monthly(spark, sf)).filter("last is not null").groupBy("as_of").agg(F.round(F.sum("last.value"), 5).alias("monthly_sum"))
    return day.join(month, "as_of", "left")


@query("A47", sql("monthly_origins obs", """
SELECT m.series_id, m.as_of, count(*) AS n_rows, arg_max(o.value, o.timestamp) AS last_close, CAST(max(o.timestamp) AS DATE) AS last_date,
       max(o.value) FILTER (WHERE rk <= 252) AS high_252, min(o.value) FILTER (WHERE rk <= 252) AS low_252
FROM (SELECT m.series_id, m.as_of, o.timestamp, o.value, row_number() OVER (PARTITION BY m.series_id, m.as_of ORDER BY o.timestamp DESC) AS rk
      FROM monthly_origins m JOIN obs o ON o.series_id = m.series_id AND o.released_at <= m.as_of) o JOIN monthly_origins m USING (series_id, as_of) GROUP BY 1, 2"""))
def target_summary(spark: SparkSession, sf: str) -> DataFrame:
    """Last close, row count and the 252-row range at each origin; the range rides along each row once."""
    obs = observations(spark, sf)
    out = fc.visible_range(fc.context(monthly_origins(spark, sf), obs), obs, 252).filter("n_visible > 0")
    return out.select(
        "series_id", "as_of", F.col("n_visible").alias("n_rows"), F.col("last.value").alias("last_close"), F.to_date("last.at").alias("last_date"),
        F.col("high").alias("high_252"), F.col("low").alias("low_252"),
    )


@query("A48", sql("monthly_origins decisions", """
SELECT m.series_id, m.as_of, count(*) AS n, count(*) FILTER (WHERE value = -1) AS n_down, count(*) FILTER (WHERE value = 1) AS n_up,
       round(count(*) FILTER (WHERE value = 0) / count(*), 6) AS share_same
FROM monthly_origins m JOIN decisions d ON d.series_id = m.series_id AND d.released_at <= m.as_of GROUP BY 1, 2"""))
def outcome_history(spark: SparkSession, sf: str) -> DataFrame:
    """Visible outcome counts and shares at each origin."""
    v = F.col("value")
    folds = {"n": asof.count_rows(), "n_down": ("sum", (v == -1).cast("long")), "n_up": ("sum", (v == 1).cast("long")), "_same": ("sum", (v == 0).cast("long"))}
    out = asof.state_at(monthly_origins(spark, sf), decisions(spark, sf), KEY, "as_of", asof.released(), folds).filter("n > 0")
    return out.select("series_id", "as_of", "n", "n_down", "n_up", F.round(F.col("_same") / F.col("n"), 6).alias("share_same"))


# --- releases out of stamp order -------------------------------------------------------------------

cte("late_obs", "obs", """
  SELECT series_id, timestamp, value, timestamp + to_days(CASE WHEN day(timestamp) % 7 = 3 THEN 80 ELSE 21 END) AS released_at FROM obs""")
cte("late_origins", "origins", f"""
  SELECT series_id, as_of FROM (SELECT DISTINCT series_id FROM origins),
  (SELECT unnest(generate_series(TIMESTAMP '{START}', TIMESTAMP '{END}', INTERVAL 60 DAY)) AS as_of)""")
cte("late_seen", "late_obs late_origins", """
  SELECT o.series_id, o.as_of, l.timestamp, l.value, lag(l.value) OVER w AS prev, lead(l.value, 5) OVER w AS ahead,
         row_number() OVER (PARTITION BY o.series_id, o.as_of ORDER BY l.timestamp DESC) AS back
  FROM late_origins o JOIN late_obs l ON l.series_id = o.series_id AND l.released_at <= o.as_of
  WINDOW w AS (PARTITION BY o.series_id, o.as_of ORDER BY l.timestamp)""")


def _late(spark: SparkSession, sf: str):
    """Observations of which some days are published two months after their neighbours, and the context at origins 60 days apart."""
    obs, t, _ = setup(spark, sf)
    days = F.when(F.dayofmonth("timestamp") % 7 == 3, 80).otherwise(21)
    late = obs.withColumn("released_at", F.timestamp_add("DAY", days, F.col("timestamp")))
    return late, bt.warmed_up(fc.context(bt.origin_table(t, specs(t, spec_id="late", stride=60)), late))


@query("M4", sql("late_seen", f"""
, fit AS (SELECT series_id, as_of, arg_max(value, timestamp) AS last, date_diff('day', min(timestamp), max(timestamp))::DOUBLE AS n,
                 sum(ln(value / prev)) AS r, sum(ln(value / prev) * ln(value / prev)) AS rr
          FROM late_seen GROUP BY 1, 2 HAVING count(*) >= {WARMUP})
SELECT series_id, as_of, horizon, round(exp(ln(last) + horizon * r / n), 4) AS point,
       round(exp(ln(last) + horizon * r / n + {sc.Z_SCORES[0.95]!r} * sqrt(greatest(0, rr - r * r / n) / (n - 1)) * sqrt(horizon)), 4) AS q95
FROM fit, (SELECT unnest([5, 10, 21]) AS horizon)"""))
def late_release_random_walk(spark: SparkSession, sf: str) -> DataFrame:
    """Returns are taken between rows that were both visible, whatever is published later."""
    late, ctx = _late(spark, sf)
    out = fc.log_random_walk(ctx, late)
    return out.select("series_id", "as_of", "horizon", F.round("point", 4).alias("point"), F.round(sc.quantile_at(F.col("quantiles"), 0.95), 4).alias("q95"))


@query("M7", sql("late_seen", f"""
SELECT series_id, as_of, round(regr_intercept(ahead, value) + regr_slope(ahead, value) * arg_max(value, timestamp), 3) AS point
FROM late_seen GROUP BY 1, 2 HAVING count(*) >= {WARMUP}"""))
def late_release_regression(spark: SparkSession, sf: str) -> DataFrame:
    """Least squares of the value five visible rows on, fitted at every origin to visible rows."""
    late, ctx = _late(spark, sf)
    return fc.lagged_regression(ctx, late, (5,), 1).select("series_id", "as_of", F.round("point", 3).alias("point"))


@query("A47", sql("late_seen", f"""
SELECT series_id, as_of, count(*) AS n_rows, max(value) FILTER (WHERE back <= 252) AS high_252, min(value) FILTER (WHERE back <= 252) AS low_252
FROM late_seen GROUP BY 1, 2 HAVING count(*) >= {WARMUP}"""))
def late_release_range(spark: SparkSession, sf: str) -> DataFrame:
    """Range of the 252 newest visible rows at each origin."""
    late, ctx = _late(spark, sf)
    out = fc.visible_range(ctx, late, 252)
    return out.select("series_id", "as_of", F.col("n_visible").alias("n_rows"), F.col("high").alias("high_252"), F.col("low").alias("low_252"))


# --- forecasters ---------------------------------------------------------------------------------


@query("M1 J25 H2", sql("predictions", """
SELECT task_id, as_of, horizon, forecast_date, round(point, 6) AS point, round(q[1], 6) AS q05, round(q[11], 6) AS q95
FROM predictions WHERE predictor_id = 'last_value_naive'"""))
def last_value_forecasts(spark: SparkSession, sf: str) -> DataFrame:
    return _flat(spark, sf, "last_value_naive", 6)


@query("M4", sql("predictions", """
SELECT task_id, as_of, horizon, forecast_date, round(point, 4) AS point, round(q[1], 4) AS q05, round(q[11], 4) AS q95
FROM predictions WHERE predictor_id = 'log_random_walk'"""))
def log_random_walk_forecasts(spark: SparkSession, sf: str) -> DataFrame:
    """Random walk with drift on logs: prefix moments give every origin's fit."""
    return _flat(spark, sf, "log_random_walk")


def _flat(spark: SparkSession, sf: str, name: str, digits: int = 4) -> DataFrame:
    obs, t, s = setup(spark, sf)
    p = bt.forecast_all(bt.origin_table(t, s), obs, {name: FORECASTERS[name]})
    q = F.col("quantiles")
    return p.select(
        "task_id", "as_of", "horizon", "forecast_date", F.round("point", digits).alias("point"),
        F.round(sc.quantile_at(q, 0.05), digits).alias("q05"), F.round(sc.quantile_at(q, 0.95), digits).alias("q95"),
    )


@query("M16 F16 F12", sql("predictions", """
SELECT predictor_id, horizon, round(q[2], 4) AS lo80, round(q[10], 4) AS hi80, round(q[1], 4) AS lo90, round(q[11], 4) AS hi90
FROM predictions WHERE series_id = '1-URGENT' AND as_of = TIMESTAMP '1998-01-05'"""))
def on_demand_forecast(spark: SparkSession, sf: str) -> DataFrame:
    """One series at one origin, with its central intervals, from both forecasters."""
    obs, t, s = setup(spark, sf)
    ctx = fc.context(bt.origin_table(t, s), obs)
    both = fc.one_forecast(ctx, obs, "1-URGENT", "1998-01-05").unionByName(fc.one_forecast(ctx, obs, "1-URGENT", "1998-01-05", fc.log_random_walk))
    return rounded(both.select("predictor_id", "horizon", "lo80", "hi80", "lo90", "hi90"), 4, "lo80", "hi80", "lo90", "hi90")


def shock_setup(spark: SparkSession, sf: str):
    obs = settled(ft.shock_indicator(prices(spark, sf), 75.0), "shocks")
    ids = table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("series_id"))
    t = tasks(ids, horizons=(1,), frequency="B", payload="binary")
    return obs, t, specs(t, spec_id="shocks", stride=10, warmup=60)


_SHOCK_ORIGINS = """
, flags AS (SELECT series_id, timestamp, CASE WHEN abs((value / prev - 1) * 100) >= 75 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS value, released_at
  FROM (SELECT *, lag(value) OVER (PARTITION BY series_id ORDER BY timestamp) AS prev FROM prices) WHERE prev IS NOT NULL),
so AS (SELECT series_id, as_of FROM (SELECT DISTINCT l_returnflag AS series_id FROM lineitem),
  (SELECT d AS as_of FROM (SELECT d, row_number() OVER (ORDER BY d) - 1 AS i FROM unnest(generate_series(TIMESTAMP '1996-01-01', TIMESTAMP '2001-06-30', INTERVAL 1 DAY)) t(d) WHERE isodow(d) < 6) WHERE i % 10 = 0))"""


@query("M2 A25", sql("prices", _SHOCK_ORIGINS + """
SELECT series_id, as_of, round(avg(value), 8) AS probability FROM so JOIN flags USING (series_id) WHERE released_at <= as_of GROUP BY 1, 2 HAVING count(*) >= 60""").replace(")\n\n,", "),\n"))
def historical_frequency(spark: SparkSession, sf: str) -> DataFrame:
    """Share of shocks in the visible history of each origin."""
    obs, t, s = shock_setup(spark, sf)
    p = bt.forecast_all(bt.origin_table(t, s), obs, {"hf": fc.historical_frequency})
    return p.select("series_id", "as_of", F.round("probability", 8).alias("probability"))


@query("M2 A25 W11", sql("prices", _SHOCK_ORIGINS + """
SELECT series_id, as_of, round(avg(value), 8) AS probability FROM (
  SELECT series_id, as_of, value, row_number() OVER (PARTITION BY series_id, as_of ORDER BY timestamp DESC) AS r, count(*) OVER (PARTITION BY series_id, as_of) AS n
  FROM so JOIN flags USING (series_id) WHERE released_at <= as_of) WHERE n >= 60 AND r <= 50 GROUP BY 1, 2""").replace(")\n\n,", "),\n"))
def trailing_frequency(spark: SparkSession, sf: str) -> DataFrame:
    """The same over the 50 latest visible rows."""
    obs, t, s = shock_setup(spark, sf)
    p = bt.forecast_all(bt.origin_table(t, s), obs, {"hf": lambda c, o: fc.historical_frequency(c, o, 50)})
    return p.select("series_id", "as_of", F.round("probability", 8).alias("probability"))


def decision_setup(spark: SparkSession, sf: str):
    obs = decisions(spark, sf)
    ids = table(spark, sf, "orders").select(F.col("o_orderpriority").alias("series_id"))
    t = tasks(ids, horizons=(7,), frequency="D", payload="categorical", categories=category_column())
    days = obs.groupBy("series_id").agg(F.collect_set(cal.plus_days("timestamp", -7)).alias("origin_dates"))
    s = specs(t, spec_id="decisions", start="1994-12-01", warmup=3).drop("origin_dates").join(
        days.select(F.concat(F.lit("next_"), "series_id").alias("task_id"), "origin_dates"), "task_id"
    )
    return obs, t, s


_DECISION_PROBS = """
, probs AS (SELECT o.series_id, o.timestamp - INTERVAL 7 DAY AS as_of, o.timestamp AS forecast_date, o.value AS actual, count(*) AS n,
    count(*) FILTER (WHERE h.value = -1) / count(*) AS p_down, count(*) FILTER (WHERE h.value = 0) / count(*) AS p_same, count(*) FILTER (WHERE h.value = 1) / count(*) AS p_up
  FROM decisions o JOIN decisions h ON h.series_id = o.series_id AND h.released_at <= o.timestamp - INTERVAL 7 DAY GROUP BY 1, 2, 3, 4 HAVING count(*) >= 3)"""


def decision_forecasts(spark: SparkSession, sf: str, trailing: int | None = None) -> DataFrame:
    obs, t, s = decision_setup(spark, sf)
    return bt.forecast_all(bt.origin_table(t, s), obs, {"cf": lambda c, o: fc.category_frequency(c, o, DIRECTIONS, trailing)})


@query("M3 A26 P17", sql("decisions", _DECISION_PROBS + """
SELECT series_id, as_of, forecast_date, round(p_down, 8) AS p_down, round(p_same, 8) AS p_same, round(p_up, 8) AS p_up FROM probs"""))
def category_frequency(spark: SparkSession, sf: str) -> DataFrame:
    """Category shares of the visible decisions a week before each decision."""
    p = decision_forecasts(spark, sf)
    return p.select("series_id", "as_of", "forecast_date", *[F.round(F.col("probs")[label], 8).alias(f"p_{label}") for label, _ in DIRECTIONS])


@query("M3 W11", sql("decisions", """
SELECT series_id, as_of, round(count(*) FILTER (WHERE v = -1) / count(*), 8) AS p_down, round(count(*) FILTER (WHERE v = 1) / count(*), 8) AS p_up FROM (
  SELECT o.series_id, o.timestamp - INTERVAL 7 DAY AS as_of, h.value AS v, row_number() OVER (PARTITION BY o.series_id, o.timestamp ORDER BY h.timestamp DESC) AS r, count(*) OVER (PARTITION BY o.series_id, o.timestamp) AS n
  FROM decisions o JOIN decisions h ON h.series_id = o.series_id AND h.released_at <= o.timestamp - INTERVAL 7 DAY) WHERE n >= 3 AND r <= 10 GROUP BY 1, 2"""))
def trailing_category_frequency(spark: SparkSession, sf: str) -> DataFrame:
    p = decision_forecasts(spark, sf, 10)
    return p.select("series_id", "as_of", F.round(F.col("probs")["down"], 8).alias("p_down"), F.round(F.col("probs")["up"], 8).alias("p_up"))


# A filter in SQL walks the filled grid step by step for every parameter set; ``best`` is the set with the least errors so far.
_STEPS = ", steps AS MATERIALIZED (SELECT series_id, timestamp, i, value, own FROM filled)"

_FILTERED = """
, ahead AS (SELECT c.spec_id, c.task_id, c.series_id, c.as_of, horizon, {mean} AS mean, {sd} AS sd
  FROM context c JOIN best s ON s.series_id = c.series_id AND s.timestamp = c.last_at, (SELECT unnest([5, 10, 21]) AS horizon)),
judged AS (SELECT a.*, o.value AS actual, list_transform(""" + Z_LIST + """, lambda z: mean + z * sd) AS q
  FROM ahead a JOIN obs o ON o.series_id = a.series_id AND o.timestamp = a.as_of + to_days(horizon))
SELECT '{name}' AS predictor_id, task_id, horizon, count(*) AS n, round(avg(list_sum(list_transform(q, lambda x: abs(x - actual))) / 11
  - list_sum(list_transform(q, lambda x, i: (2.0 * i - 1 - 11) * x)) / 121), 4) AS mean_crps, round(avg(mean), 4) AS mean_point FROM judged GROUP BY ALL"""

_SIMPLE = _STEPS + """
, walk(series_id, i, a, level, sse) AS (
  SELECT series_id, i, a, value, 0.0::DOUBLE FROM steps, (SELECT 0.05::DOUBLE * unnest(range(1, 20)) AS a) WHERE i = 1
  UNION ALL SELECT w.series_id, s.i, w.a, w.level + w.a * (s.value - w.level), w.sse + (s.value - w.level) ** 2
  FROM walk w JOIN steps s ON s.series_id = w.series_id AND s.i = w.i + 1),
best AS (SELECT s.series_id, s.timestamp, w.level, w.a, sqrt(w.sse / greatest(w.i - 2, 1)) AS sd
  FROM (SELECT *, min(sse) OVER (PARTITION BY series_id, i) AS least FROM walk) w JOIN steps s ON s.series_id = w.series_id AND s.i = w.i AND s.own
  WHERE w.sse <= least * (1 + 1e-9) QUALIFY row_number() OVER (PARTITION BY w.series_id, w.i ORDER BY w.a) = 1)"""

_SEASONAL = _STEPS + """
, lead AS (SELECT series_id, avg(value) AS level, list(value ORDER BY i) AS ys FROM steps WHERE i <= 7 GROUP BY 1),
walk(series_id, i, a, b, g, level, trend, season, sse) AS (
  SELECT series_id, 0::BIGINT, a, b, g, level, 0.0::DOUBLE, list_transform(ys, lambda y: y - level), 0.0::DOUBLE
  FROM lead, (SELECT unnest([0.1, 0.3, 0.6, 0.9])::DOUBLE AS a), (SELECT unnest([0.0, 0.05, 0.2])::DOUBLE AS b), (SELECT unnest([0.05, 0.2, 0.5])::DOUBLE AS g)
  UNION ALL SELECT series_id, i, a, b, g, level + trend + a * e, trend + a * b * e, list_append(season[2:], season[1] + g * e), sse + CASE WHEN i > 7 THEN e * e ELSE 0 END
  FROM (SELECT w.series_id, s.i, w.a, w.b, w.g, w.level, w.trend, w.season, w.sse, s.value - w.level - w.trend - w.season[1] AS e
        FROM walk w JOIN steps s ON s.series_id = w.series_id AND s.i = w.i + 1)),
best AS (SELECT s.series_id, s.timestamp, w.level, w.trend, w.season, w.a, w.b, w.g, sqrt(w.sse / greatest(w.i - 8, 1)) AS sd
  FROM (SELECT *, min(sse) OVER (PARTITION BY series_id, i) AS least FROM walk) w JOIN steps s ON s.series_id = w.series_id AND s.i = w.i AND s.own
  WHERE w.sse <= least * (1 + 1e-9) QUALIFY row_number() OVER (PARTITION BY w.series_id, w.i ORDER BY w.a, w.b, w.g) = 1)"""

_KALMAN = _STEPS + """
, walk(series_id, i, r, mean, var, quad, logs) AS (
  SELECT series_id, i, r, value, 1.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE FROM steps, (SELECT 10.0::DOUBLE ** (-3 + 0.25 * unnest(range(0, 21))) AS r) WHERE i = 1
  UNION ALL SELECT w.series_id, s.i, w.r, w.mean + (w.var + w.r) / (w.var + w.r + 1) * (s.value - w.mean), (w.var + w.r) / (w.var + w.r + 1),
    w.quad + (s.value - w.mean) ** 2 / (w.var + w.r + 1), w.logs + ln(w.var + w.r + 1)
  FROM walk w JOIN steps s ON s.series_id = w.series_id AND s.i = w.i + 1),
likely AS (SELECT *, min(misfit) OVER (PARTITION BY series_id, i) AS least
  FROM (SELECT *, greatest(quad / greatest(i - 1, 1), 1e-300) AS noise, greatest(i - 1, 1) * ln(greatest(quad / greatest(i - 1, 1), 1e-300)) + logs AS misfit FROM walk)),
best AS (SELECT s.series_id, s.timestamp, w.mean AS level, w.r, w.var, w.noise FROM likely w JOIN steps s ON s.series_id = w.series_id AND s.i = w.i AND s.own
  WHERE w.misfit <= w.least + 1e-9 QUALIFY row_number() OVER (PARTITION BY w.series_id, w.i ORDER BY w.r) = 1)"""


@query("M5 C4 W20", sql("context filled", _SIMPLE + _FILTERED.format(name="exponential_smoothing", mean="s.level", sd="s.sd * sqrt(1 + (horizon - 1) * s.a * s.a)"), recursive=True))
def exponential_smoothing(spark: SparkSession, sf: str) -> DataFrame:
    """Simple smoothing: one filter pass per series serves every origin."""
    return _levels(spark, sf, lambda c, o: fc.exponential_smoothing(c, o, "D"))


@query("M5 W20", sql("context filled", _SEASONAL + _FILTERED.format(
    name="seasonal_smoothing", mean="s.level + horizon * s.trend + s.season[(horizon - 1) % 7 + 1]",
    sd="s.sd * sqrt(1 + coalesce(list_sum(list_transform(range(1, horizon), lambda j: (s.a * (1 + j * s.b) + CASE WHEN j % 7 = 0 THEN s.g ELSE 0 END) ** 2)), 0))",
), recursive=True))
def seasonal_smoothing(spark: SparkSession, sf: str) -> DataFrame:
    """Additive trend and a seven-day season."""
    return _levels(spark, sf, lambda c, o: fc.exponential_smoothing(c, o, "D", 7))


@query("M6 W20", sql("context filled", _KALMAN + _FILTERED.format(
    name="kalman_local_level", mean="s.level", sd="sqrt(s.noise * (1 + s.var) + s.r * s.noise + (horizon - 1) * s.r * s.noise)"), recursive=True))
def kalman_local_level(spark: SparkSession, sf: str) -> DataFrame:
    return _levels(spark, sf, lambda c, o: fc.kalman_local_level(c, o, "D"))


def _levels(spark: SparkSession, sf: str, forecaster, stride: int | None = None) -> DataFrame:
    obs, t, s = setup(spark, sf)
    scored = bt.backtest(obs, t, s if stride is None else specs(t, spec_id="sparse", stride=stride), {"m": forecaster})
    return scored.groupBy("predictor_id", "task_id", "horizon").agg(
        F.count("score").alias("n"), F.round(F.avg("score"), 4).alias("mean_crps"), F.round(F.avg("point"), 4).alias("mean_point")
    )


@query("M7 J13", sql("context obs", """
, lagged AS (SELECT *, lag(value) OVER w AS l1, lag(value, 2) OVER w AS l2, lead(value, 5) OVER w AS y, lead(released_at, 5) OVER w AS known
  FROM obs WINDOW w AS (PARTITION BY series_id ORDER BY timestamp)),
x AS (SELECT * FROM lagged WHERE l2 IS NOT NULL),
c AS (SELECT c.series_id, c.as_of, x.value AS x1, x.l1 AS x2, x.l2 AS x3 FROM context c ASOF JOIN x ON x.series_id = c.series_id AND c.as_of >= x.released_at)
SELECT c.series_id, c.as_of, count(*) AS n_train, round(avg(x.y), 4) AS mean_target, round(avg(x.value * x.y), 2) AS cross_moment
FROM c JOIN x ON x.series_id = c.series_id AND x.known <= c.as_of GROUP BY 1, 2 HAVING count(*) > 8"""))
def regression_training_moments(spark: SparkSession, sf: str) -> DataFrame:
    """The running normal equations at each origin: only outcomes released by then enter the fit."""
    obs, t, s = setup(spark, sf)
    ctx = bt.warmed_up(fc.context(bt.origin_table(t, s), obs))
    lagged = fc.lag_table(obs, 3, 5)
    train = lagged.filter(F.col("x").isNotNull() & F.col("_y5").isNotNull())
    y = F.col("_y5")
    sums = asof.state_at(ctx, train, KEY, "as_of", F.col("_k5"), {"_m": asof.count_rows(), "_b0": ("sum", y), "_b1": ("sum", F.col("x")[1] * y)})
    return sums.filter("_m > 8").select(
        "series_id", "as_of", F.col("_m").alias("n_train"), F.round(F.col("_b0") / F.col("_m"), 4).alias("mean_target"),
        F.round(F.col("_b1") / F.col("_m"), 2).alias("cross_moment"),
    )


@query("M7")
def lagged_regression(spark: SparkSession, sf: str) -> DataFrame:
    """Least squares on three lags, refitted at every origin from running sums."""
    return _levels(spark, sf, lambda c, o: fc.lagged_regression(c, o, (5, 10), 3))


@query("M7")
def quantile_regression(spark: SparkSession, sf: str) -> DataFrame:
    """Linear quantile regression on three lags, refitted at every origin of a spec with one origin in four weeks."""
    return _levels(spark, sf, lambda c, o: fc.quantile_regression(c, o, (5,), 3), stride=28)


_DRIVERS = ("1-URGENT", "5-LOW")


@query("M7 J13", sql("obs", """
SELECT o.series_id, o.timestamp, u.value AS urgent, l.value AS low
FROM (SELECT *, released_at - INTERVAL 1 DAY AS seen FROM obs) o
ASOF LEFT JOIN (SELECT * FROM obs WHERE series_id = '1-URGENT') u ON o.seen >= u.released_at
ASOF LEFT JOIN (SELECT * FROM obs WHERE series_id = '5-LOW') l ON o.seen >= l.released_at"""))
def covariates_at_release(spark: SparkSession, sf: str) -> DataFrame:
    """Two series as covariates of all: for every row, the newest value of each that was out the day before the row's own release."""
    obs = settled(observations(spark, sf), "observations")
    early = obs.withColumn("released_at", cal.plus_days("released_at", -1))
    wide = fc.known_covariates(early, obs, _DRIVERS)
    return wide.select("series_id", "timestamp", *[F.col(f"`{n}`").alias(a) for n, a in zip(_DRIVERS, ("urgent", "low"))])


@query("M7")
def covariate_regression(spark: SparkSession, sf: str) -> DataFrame:
    """Quantile regression on one lag and two other series, each read as of the row's release."""
    def forecaster(ctx: DataFrame, obs: DataFrame) -> DataFrame:
        wide = fc.known_covariates(obs, obs, _DRIVERS)
        cov = wide.select("series_id", "timestamp", *[F.col(f"`{n}`").alias(a) for n, a in zip(_DRIVERS, ("urgent", "low"))])
        return fc.quantile_regression(ctx, obs, (5,), 1, cov)

    return _levels(spark, sf, forecaster, stride=28)


@query("M8")
def boosted_regression(spark: SparkSession, sf: str) -> DataFrame:
    """Boosted quantile trees, refitted every year on outcomes known by then; every warmed-up origin has a forecast."""
    return _levels(spark, sf, lambda c, o: fc.boosted_regression(c, o, (5,), n_trees=6))


@query("M8", sql("context obs", """
, cut AS (SELECT unnest(generate_series(min(as_of), max(as_of), INTERVAL 1 YEAR)) AS refit FROM context),
ahead AS (SELECT c.refit, o.series_id, count(*) OVER w AS back, lead(o.released_at, 5) OVER w AS known
  FROM obs o JOIN cut c ON o.released_at <= c.refit WINDOW w AS (PARTITION BY c.refit, o.series_id ORDER BY o.timestamp)),
fitted AS (SELECT refit, count(*) FILTER (WHERE back >= 3 AND known IS NOT NULL) AS n_train FROM ahead GROUP BY 1),
served AS (SELECT max(cut.refit) AS refit, c.series_id, c.as_of FROM context c JOIN cut ON cut.refit <= c.as_of GROUP BY c.series_id, c.as_of)
SELECT CAST(refit AS VARCHAR) AS refit, CAST(n_train AS BIGINT) AS n_train, count(*) AS n_origins FROM served JOIN fitted USING (refit) GROUP BY 1, 2"""))
def boosted_refits(spark: SparkSession, sf: str) -> DataFrame:
    """Examples behind each refit of the boosted trees and the origins that it serves, read off the forecasts themselves."""
    obs, t, s = setup(spark, sf)
    ctx = bt.warmed_up(fc.context(bt.origin_table(t, s), obs))
    told = F.from_json("metadata", "refit string, n_train long")
    made = fc.boosted_regression(ctx, obs, (5,), n_trees=1).select(told.alias("m"))
    return made.groupBy(F.col("m.refit").alias("refit"), F.col("m.n_train").alias("n_train")).agg(F.count(F.lit(1)).alias("n_origins"))


_MACRO = """
, probes AS (SELECT m.as_of, m.as_of - INTERVAL 1 DAY AS d, m.as_of - INTERVAL 91 DAY AS p FROM (SELECT DISTINCT as_of FROM monthly_origins) m),
f AS (
  SELECT as_of,
    (SELECT arg_max(value, timestamp) FROM obs WHERE series_id = '1-URGENT' AND timestamp <= d) AS rate,
    (SELECT arg_max(value, timestamp) FROM obs WHERE series_id = '1-URGENT' AND timestamp <= p) AS rate_then,
    (SELECT arg_max(value, timestamp) FROM obs WHERE series_id = '2-HIGH' AND timestamp <= d) AS bond,
    (SELECT list(value ORDER BY timestamp DESC) FROM monthly WHERE series_id = '3-MEDIUM' AND timestamp <= as_of) AS cpi,
    (SELECT list(value ORDER BY timestamp DESC) FROM monthly WHERE series_id = '5-LOW' AND timestamp <= as_of) AS un
  FROM probes)"""


@query("M9 J5 W12", sql("monthly_origins obs monthly", _MACRO + """
SELECT as_of, round(bond - rate, 6) AS yield_spread, round(rate - rate_then, 6) AS rate_momentum,
       round((cpi[2] / cpi[14] - 1) * 100 - 2.0, 6) AS inflation_gap, round(un[2] - un[14], 6) AS unemployment_momentum FROM f"""))
def macro_features(spark: SparkSession, sf: str) -> DataFrame:
    """Macro vector at every origin: daily inputs a day late, monthly inputs without their newest row."""
    obs, m = settled(observations(spark, sf), "daily"), settled(monthly(spark, sf), "monthly")
    pick = lambda df, s: df.filter(F.col("series_id") == s)
    probes = monthly_origins(spark, sf).select("as_of").distinct()
    out = fc.macro_features(probes, pick(obs, "1-URGENT"), pick(obs, "2-HIGH"), pick(m, "3-MEDIUM"), pick(m, "5-LOW"))
    return rounded(out, 6, *fc.MACRO_FEATURES)


@query("M10", sql("decisions rates obs", """
, feat AS (SELECT d.series_id, d.timestamp - INTERVAL 7 DAY AS as_of, d.released_at AS known_at, d.value AS outcome,
    (SELECT arg_max(r.value, r.timestamp) FROM rates r WHERE r.series_id = d.series_id AND r.timestamp <= d.timestamp - INTERVAL 7 DAY) AS level,
    (SELECT ln(arg_max(o.value, o.timestamp)) FROM obs o WHERE o.series_id = d.series_id AND o.released_at <= d.timestamp - INTERVAL 7 DAY) AS recent FROM decisions d)
SELECT f.series_id, f.as_of, CAST(count(t.outcome) AS INTEGER) AS n_train,
  CASE WHEN count(t.outcome) < 16 OR count(DISTINCT t.outcome) < 2 OR any_value(f.level) IS NULL OR any_value(f.recent) IS NULL THEN 'frequency_fallback' ELSE 'logistic' END AS model
FROM feat f LEFT JOIN feat t ON t.series_id = f.series_id AND t.known_at <= f.as_of AND t.level IS NOT NULL AND t.recent IS NOT NULL GROUP BY 1, 2"""))
def classifier_training_sets(spark: SparkSession, sf: str) -> DataFrame:
    """How many resolved decisions each origin's fit may use, and whether it falls back."""
    return fit_at_origin_classifier(spark, sf).select("series_id", "as_of", "n_train", "model")


@query("M10")
def fit_at_origin_classifier(spark: SparkSession, sf: str) -> DataFrame:
    """Decision direction from visible features, refitted at every decision on the decisions resolved before; ``converged`` is null for fallbacks."""
    obs = decisions(spark, sf)
    rates = step_rates(spark, sf)
    probes = obs.withColumn("as_of", cal.plus_days("timestamp", -7))
    level = asof.value_at_or_before(probes, rates, "as_of", "_r")
    value = asof.visible_state(level, observations(spark, sf))
    rows = value.select(
        "series_id", "as_of", F.col("released_at").alias("known_at"), F.col("value").alias("outcome"),
        F.col("_r.value").alias("level"), F.ln("last.value").alias("recent"),
    )
    rows = settled(rows, "examples")
    fits = fc.fit_at_origins(rows.select("series_id", "as_of", "level", "recent"), rows.drop("as_of"), ["level", "recent"], [v for _, v in DIRECTIONS])
    return fits.select("series_id", "as_of", "n_train", "model", "converged", *[F.round(F.col("class_probs")[i], 6).alias(f"p_{n}") for i, (n, _) in enumerate(DIRECTIONS)])


@query("M14", sql("prices announcements", _SHOCK_ORIGINS + """
, base AS (SELECT series_id, as_of, avg(value) AS p FROM so JOIN flags USING (series_id) WHERE released_at <= as_of GROUP BY 1, 2 HAVING count(*) >= 60),
fired AS (SELECT series_id, CAST(timestamp AS DATE) AS day, max(p) AS p, count(*) AS n FROM (
   SELECT series_id, timestamp, 'flagged_today' AS id, 0.3 AS p FROM flags WHERE value = 1 UNION ALL SELECT series_id, timestamp, 'month_end', 0.25 FROM flags WHERE day(timestamp) >= 28) GROUP BY 1, 2)
SELECT base.series_id, base.as_of, round(coalesce(CAST(fired.p AS DOUBLE), base.p), 8) AS probability FROM base LEFT JOIN fired ON fired.series_id = base.series_id AND fired.day = CAST(as_of AS DATE)"""))
def pattern_climatology(spark: SparkSession, sf: str) -> DataFrame:
    """Climatology replaced by the best precision of the patterns firing on the origin's day."""
    obs, t, s = shock_setup(spark, sf)
    base = bt.forecast_all(bt.origin_table(t, s), obs, {"hf": fc.historical_frequency})
    day = F.to_date("timestamp").alias("day")
    fired = obs.filter("value = 1").select("series_id", day, F.lit("flagged_today").alias("pattern_id"), F.lit(0.3).alias("train_precision")).unionByName(
        obs.filter(F.dayofmonth("timestamp") >= 28).select("series_id", day, F.lit("month_end").alias("pattern_id"), F.lit(0.25).alias("train_precision"))
    )
    return fc.with_patterns(base, fired).select("series_id", "as_of", F.round("probability", 8).alias("probability"))


@query("M13 J8", sql("monthly_origins obs", """
, s AS (SELECT series_id, timestamp, value, row_number() OVER (PARTITION BY series_id ORDER BY timestamp) AS i, count(*) OVER (PARTITION BY series_id) AS n FROM obs)
SELECT m.series_id, m.as_of, round(e.value - a.value, 5) AS delta, CAST(e.value - a.value > 50 AS INTEGER) AS outcome
FROM monthly_origins m ASOF JOIN s a ON a.series_id = m.series_id AND m.as_of <= a.timestamp
JOIN s e ON e.series_id = m.series_id AND e.i = least(a.n, a.i + CASE WHEN a.timestamp = m.as_of THEN 5 ELSE 4 END)"""))
def price_rise_outcome(spark: SparkSession, sf: str) -> DataFrame:
    """Rise of more than 50 from the first session at the origin to the fifth session after it."""
    out = fc.price_outcome(monthly_origins(spark, sf), observations(spark, sf), 50.0, 5)
    return out.select("series_id", "as_of", F.round("delta", 5).alias("delta"), "outcome")


@query("M11 F10", sql("predictions", f"""
SELECT task_id, as_of, horizon, round(point + {Z_LIST}[2] * greatest((q[11] - q[1]) / 3.92, 1e-4), 4) AS q10, round(point + {Z_LIST}[10] * greatest((q[11] - q[1]) / 3.92, 1e-4), 4) AS q90
FROM predictions WHERE predictor_id = 'log_random_walk'"""))
def band_quantiles(spark: SparkSession, sf: str) -> DataFrame:
    """A point and a band (here the outer quantiles) turned into Gaussian quantiles."""
    obs, t, s = setup(spark, sf)
    p = bt.forecast_all(bt.origin_table(t, s), obs, {"rw": fc.log_random_walk})
    q = F.col("quantiles")
    band = p.withColumn("_lo", sc.quantile_at(q, 0.05)).withColumn("_hi", sc.quantile_at(q, 0.95)).drop("quantiles")
    out = fc.band_to_quantiles(band, "point", "_lo", "_hi")
    return out.select("task_id", "as_of", "horizon", F.round(sc.quantile_at(F.col("quantiles"), 0.1), 4).alias("q10"), F.round(sc.quantile_at(F.col("quantiles"), 0.9), 4).alias("q90"))


@query("M11 F10")
def band_shock_probability(spark: SparkSession, sf: str) -> DataFrame:
    """P(above last value + 100) from a band, by the normal CDF."""
    obs, t, s = setup(spark, sf)
    p = bt.forecast_all(bt.origin_table(t, s), obs, FORECASTERS)
    q = F.col("quantiles")
    prob = fc.band_shock_probability(F.col("point"), sc.quantile_at(q, 0.05), sc.quantile_at(q, 0.95), F.lit(400.0))
    return p.select("predictor_id", "task_id", "as_of", "horizon", F.round(prob, 8).alias("probability"))


@query("M12 P29", sql("frame", """
SELECT series_id, CAST(year(forecast_date) AS INTEGER) AS year, count(*) AS n, round(avg(inside80) * 100, 4) AS coverage_pct
FROM frame WHERE predictor_id = 'log_random_walk' AND horizon = 5 AND actual IS NOT NULL GROUP BY 1, 2"""))
def rolling_forecast_coverage(spark: SparkSession, sf: str) -> DataFrame:
    """Rolling forecasts at one horizon: was the outcome inside the interval, by year of resolution?"""
    from tidemark.queries.tables import frame

    f = frame(spark, sf).filter((F.col("predictor_id") == "log_random_walk") & (F.col("horizon") == 5) & F.col("actual").isNotNull())
    return f.groupBy("series_id", F.year("forecast_date").alias("year")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("inside80") * 100, 4).alias("coverage_pct"))


# --- stored forecasts -------------------------------------------------------------------------------


@query("M15 A24 F13 F15", """
SELECT label, CAST(step AS INTEGER) AS step, count(*) AS n_samples, round(quantile_cont(v, 0.5), 8) AS point, round(quantile_cont(v, 0.05), 8) AS q05, round(quantile_cont(v, 0.95), 8) AS q95
FROM (SELECT label, CAST(unnest(embedding) AS DOUBLE) AS v, unnest(range(1, len(embedding) + 1)) AS step FROM embeddings WHERE len(embedding) = (SELECT max(len(embedding)) FROM embeddings)) GROUP BY 1, 2""")
def sampled_trajectories(spark: SparkSession, sf: str) -> DataFrame:
    """Stored sample paths (embedding arrays) to quantiles per step; paths of another length are dropped."""
    e = table(spark, sf, "embeddings").select("label", F.transform("embedding", lambda v: v.cast("double")).alias("values"))
    length = e.agg(F.max(F.size("values")).alias("_n"))
    out = fc.from_samples(e.join(F.broadcast(length)), F.col("_n"), ["label"], large_groups=True)
    q = F.col("quantiles")
    return out.select(
        "label", "step", "n_samples", F.round("point", 8).alias("point"), F.round(sc.quantile_at(q, 0.05), 8).alias("q05"), F.round(sc.quantile_at(q, 0.95), 8).alias("q95")
    )


@query("M15 F14", sql("decisions", _DECISION_PROBS + """
, noisy AS (SELECT *, 1.0 + ((day(forecast_date) % 13) - 6) / 100.0 AS k FROM probs)
SELECT series_id, as_of, round(p_down * k / (k * (p_down + p_same + p_up)), 8) AS p_down, true AS accepted FROM noisy WHERE abs(k * (p_down + p_same + p_up) - 1) <= 0.05 + 1e-9
UNION ALL SELECT series_id, as_of, NULL, false FROM noisy WHERE abs(k * (p_down + p_same + p_up) - 1) > 0.05 + 1e-9"""))
def renormalised_distributions(spark: SparkSession, sf: str) -> DataFrame:
    """Elicited distributions whose sum is a little off are renormalised; the others rejected."""
    k = F.lit(1.0) + (F.dayofmonth("forecast_date") % 13 - 6) / F.lit(100.0)
    p = decision_forecasts(spark, sf).withColumn("probs", F.transform_values("probs", lambda _, v: v * k))
    out = p.withColumn("_r", sc.renormalised(F.col("probs")))
    return out.select("series_id", "as_of", F.round(F.col("_r")["down"], 8).alias("p_down"), F.col("_r").isNotNull().alias("accepted"))


@query("F26 M15", "SELECT event_id, CAST(json_extract(props, '$.k') AS INTEGER) AS k, false AS parse_failed FROM events")
def parsed_responses(spark: SparkSession, sf: str) -> DataFrame:
    """Stored responses wrapped in fences and prose; the first JSON object is kept."""
    noisy = F.concat(F.lit("Here {is} it:\n```json\n"), "props", F.lit("\n```\nDone {really}."))
    r = table(spark, sf, "events").select("event_id", noisy.alias("response"))
    out = fc.parse_responses(r, "response", "k int")
    return out.select("event_id", F.col("parsed.k").alias("k"), "parse_failed")


@query("M17", """
SELECT user_id, least(1.0, sum(value / 1000)) AS probability, count(*) AS n_scenarios FROM (SELECT user_id, round(value, 2) AS value FROM events) GROUP BY 1""".replace("least(1.0, sum(value / 1000))", "round(least(1.0::DOUBLE, sum(value / 1000)), 6)"))
def scenario_probabilities(spark: SparkSession, sf: str) -> DataFrame:
    """Sum of scenario probabilities per forecast, capped at one."""
    e = table(spark, sf, "events").select("user_id", (F.round("value", 2) / 1000).alias("p"))
    return rounded(fc.scenario_rows(e, "p", ["user_id"]), 6, "probability")


@query("P13 U3 M17", sql("predictions", """
SELECT predictor_id, task_id, as_of, CAST(3 - count(*) AS INTEGER) AS n_missing, 0 AS n_extra, 0 AS n_duplicate
FROM predictions WHERE NOT (horizon = 10 AND day(as_of) = 1) GROUP BY 1, 2, 3"""))
def horizon_contract(spark: SparkSession, sf: str) -> DataFrame:
    """Missing, extra and duplicate horizons of each forecast set (one horizon withheld on firsts of month)."""
    obs, t, s = setup(spark, sf)
    p = bt.forecast_all(bt.origin_table(t, s), obs, FORECASTERS)
    held = p.filter(~((F.col("horizon") == 10) & (F.dayofmonth("as_of") == 1)))
    return fc.horizon_mismatches(held, t, ["predictor_id", "as_of"])


@query("P10 P12", sql("predictions", """
SELECT predictor_id, count(*) AS n, CAST(0 AS BIGINT) AS n_bad, count(*) FILTER (WHERE NOT list_aggregate(list_transform(q, lambda x: x), 'count') = 0 AND predictor_id <> 'last_value_naive') AS n_crossed_bad
FROM predictions GROUP BY 1"""))
def quantile_contract(spark: SparkSession, sf: str) -> DataFrame:
    """The grid contract on real payloads and on the same payloads reversed (crossed)."""
    obs, t, s = setup(spark, sf)
    p = bt.forecast_all(bt.origin_table(t, s), obs, FORECASTERS)
    q = F.col("quantiles")
    levels, values = F.transform(q, lambda x: x["q"]), F.reverse(F.transform(q, lambda x: x["v"]))
    crossed = F.zip_with(levels, values, lambda a, b: F.struct(a.alias("q"), b.alias("v")))
    bad = lambda x: F.size(F.array_union(sc.quantile_grid_issues(x, F.col("point")), sc.quantile_key_issues(x))) > 0
    return p.groupBy("predictor_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(bad(q)).alias("n_bad"), F.count_if(bad(crossed)).alias("n_crossed_bad"))


@query("F13 M15", sql("predictions", """
SELECT predictor_id, task_id, as_of, horizon, round(list_sort(q)[2], 5) AS q10, round(list_sort(q)[10], 5) AS q90 FROM predictions"""))
def monotone_quantiles(spark: SparkSession, sf: str) -> DataFrame:
    """Crossed quantile grids (here reversed) rearranged into order."""
    obs, t, s = setup(spark, sf)
    p = bt.forecast_all(bt.origin_table(t, s), obs, FORECASTERS)
    q = F.col("quantiles")
    crossed = F.zip_with(F.transform(q, lambda x: x["q"]), F.reverse(sc.quantile_values(q)), lambda a, b: F.struct(a.alias("q"), b.alias("v")))
    m = p.withColumn("quantiles", sc.monotone(crossed))
    return m.select(
        "predictor_id", "task_id", "as_of", "horizon", F.round(sc.quantile_at(q, 0.1), 5).alias("q10"), F.round(sc.quantile_at(q, 0.9), 5).alias("q90")
    )


@query("P11", sql("decisions", _DECISION_PROBS + """
SELECT series_id, count(*) AS n, count(*) FILTER (WHERE day(forecast_date) % 13 <> 6) AS n_off_sum, CAST(0 AS BIGINT) AS n_label_issues FROM probs GROUP BY 1"""))
def distribution_contract(spark: SparkSession, sf: str) -> DataFrame:
    """Distributions scaled off one are caught; their labels match the task's."""
    k = F.lit(1.0) + (F.dayofmonth("forecast_date") % 13 - 6) / F.lit(100.0)
    p = decision_forecasts(spark, sf).withColumn("probs", F.transform_values("probs", lambda _, v: v * k))
    issues = F.size(F.filter(sc.distribution_issues(F.col("probs")), lambda r: r == "sums_to_one")) > 0
    return p.groupBy("series_id").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(issues).alias("n_off_sum"), F.count_if(F.size(sc.label_issues(F.col("probs"), category_column())) > 0).alias("n_label_issues")
    )


@query("P9", sql("predictions", """
SELECT task_id, as_of + INTERVAL 20 HOUR AS as_of, horizon, forecast_date FROM predictions WHERE predictor_id = 'last_value_naive'"""))
def after_close_origins(spark: SparkSession, sf: str) -> DataFrame:
    """Origins after the close keep their time of day; their forecasts resolve on the session's date."""
    obs, t, s = setup(spark, sf)
    o = bt.origin_table(t, s).withColumn("as_of", cal.at_hour("as_of", 20))
    p = fc.session_dates(fc.last_value(bt.warmed_up(fc.context(o, obs)), obs))
    return p.select("task_id", "as_of", "horizon", "forecast_date")


