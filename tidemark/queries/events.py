"""Event studies over daily sessions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.functions import stats
from tidemark.operators import analysis as an, bootstrap as bs, events as ev, forecast as fc
from tidemark.plans import backtest as bt, study
from tidemark.queries.forecasts import _SHOCK_ORIGINS, shock_setup
from tidemark.queries.registry import query
from tidemark.queries.tables import FORECASTERS, HOLDOUT, SHOCK, days, prices, rounded, specs, sql, table, tasks
from tidemark.session import settled

KEY = ["series_id"]
LO, HI = HOLDOUT


def _days(spark: SparkSession, sf: str) -> DataFrame:
    return settled(days(spark, sf), "sessions")


@query("C6 W6 W17", sql("days", "SELECT series_id, timestamp, value, round(return_pct, 6) AS return_pct, round(vol, 6) AS vol, round(vol_before, 6) AS vol_before, CAST(idx AS BIGINT) AS idx FROM days"))
def session_table(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(days(spark, sf), 6, "return_pct", "vol", "vol_before")


@query("W10 H5", sql("shocks", "SELECT series_id, as_of, event_date, round(return_pct, 6) AS return_pct, direction, CAST(as_of_idx AS BIGINT) AS as_of_idx, CAST(event_idx AS BIGINT) AS event_idx FROM shocks"))
def shock_windows(spark: SparkSession, sf: str) -> DataFrame:
    """Clustered shock events anchored on their largest move."""
    return rounded(ev.shock_windows(days(spark, sf), SHOCK).drop("is_shock"), 6, "return_pct")


@query("A29 A27", sql("days", """
SELECT series_id, count(*) AS sessions, count(*) FILTER (WHERE shock) AS shock_sessions, count(*) FILTER (WHERE shock AND return_pct > 0) AS up, count(*) FILTER (WHERE shock AND return_pct <= 0) AS down,
  round(avg(shock::INT) * 100, 1) AS share_pct FROM days GROUP BY 1"""))
def shock_headline(spark: SparkSession, sf: str) -> DataFrame:
    return ev.shock_headline(days(spark, sf), SHOCK)


@query("A27", sql("days", f"""
SELECT series_id, CASE WHEN timestamp < '{LO}' THEN 'train' ELSE 'holdout' END AS split, unnest(['either', 'up', 'down']) AS direction,
  round(unnest([avg(shock::INT), avg((shock AND return_pct > 0)::INT), avg((shock AND return_pct < 0)::INT)]), 8) AS base_rate, count(*) AS n_sessions
FROM days WHERE timestamp <= '{HI}' GROUP BY 1, 2"""))
def base_rates(spark: SparkSession, sf: str) -> DataFrame:
    """Shock rates per split and direction."""
    return rounded(ev.base_rates(days(spark, sf), SHOCK, _split()), 8, "base_rate")


def _split():
    t = F.col("timestamp")
    return F.when(t < F.lit(LO).cast("timestamp_ntz"), F.lit("train")).when(t <= F.lit(HI).cast("timestamp_ntz"), F.lit("holdout"))


@query("W19 P24", sql("days", f"""
SELECT series_id, timestamp, CAST(period AS INTEGER) AS period, coalesce(lag(period) OVER (PARTITION BY series_id ORDER BY timestamp) <> period, true) AS straddles FROM (
  SELECT *, CASE WHEN timestamp < '{LO}' THEN 0 WHEN timestamp <= '{HI}' THEN 1 ELSE 2 END AS period FROM days)"""))
def split_periods(spark: SparkSession, sf: str) -> DataFrame:
    d = days(spark, sf).withColumn("period", ev.split_period(F.col("timestamp"), LO, HI))
    return ev.straddles(d).select("series_id", "timestamp", "period", "straddles")


_CANDIDATES = f"""
, per AS (SELECT *, coalesce(lag(period) OVER (PARTITION BY series_id ORDER BY idx) <> period, true) AS straddles FROM (
  SELECT *, CASE WHEN timestamp < '{LO}' THEN 0 WHEN timestamp <= '{HI}' THEN 1 ELSE 2 END AS period FROM days)),
bad AS (SELECT series_id, idx + o AS idx FROM days, (SELECT unnest([-2, -1, 0, 1, 2]) AS o) WHERE shock
  UNION SELECT series_id, unnest(range(as_of_idx - 2, event_idx + 3)) FROM shocks),
ok AS (SELECT * FROM per WHERE vol_before IS NOT NULL AND NOT straddles AND NOT EXISTS (SELECT 1 FROM bad WHERE bad.series_id = per.series_id AND bad.idx = per.idx)),
cand AS (SELECT s.series_id, s.event_date AS shock_date, c.idx, c.timestamp AS event_date, abs(c.vol_before - t.vol_before) AS distance,
    row_number() OVER (PARTITION BY s.series_id, s.event_date ORDER BY abs(c.vol_before - t.vol_before) NULLS LAST, c.timestamp) AS rank
  FROM shocks s LEFT JOIN per t ON t.series_id = s.series_id AND t.idx = s.as_of_idx + 1 JOIN per e ON e.series_id = s.series_id AND e.idx = s.event_idx
  JOIN ok c ON c.series_id = s.series_id AND c.idx BETWEEN s.event_idx - 126 AND s.event_idx + 126 AND c.period = e.period)"""


@query("J18 J19 T4", sql("shocks days", _CANDIDATES + " SELECT series_id, shock_date, event_date, round(distance, 6) AS distance, CAST(rank AS INTEGER) AS rank FROM cand WHERE rank <= 5"))
def control_candidates(spark: SparkSession, sf: str) -> DataFrame:
    """The five eligible controls closest in volatility to every shock."""
    d = _days(spark, sf)
    pool = ev.control_candidates(d, ev.shock_windows(d, SHOCK), SHOCK, LO, HI)
    return rounded(ev.nearest_candidates(pool), 6, "distance").select("series_id", "shock_date", "event_date", "distance", "rank")


@query("J18 H5")
def matched_controls(spark: SparkSession, sf: str) -> DataFrame:
    """One control per shock, drawn without replacement in rounds."""
    d = _days(spark, sf)
    pool = ev.control_candidates(d, ev.shock_windows(d, SHOCK), SHOCK, LO, HI)
    return ev.matched_controls(d, pool).drop("direction")


@query("J18 H5")
def control_shortage(spark: SparkSession, sf: str) -> DataFrame:
    """Shocks of each series that got fewer than three controls."""
    d = _days(spark, sf)
    shocks = settled(ev.shock_windows(d, SHOCK), "shocks")
    return ev.control_shortage(shocks, ev.draw_controls(ev.control_candidates(d, shocks, SHOCK, LO, HI), 3), 3)


@query("H5 P24 W10", sql("shocks", f"""
SELECT series_id, CASE WHEN event_date < '{LO}' THEN 'train' WHEN as_of >= '{LO}' AND event_date <= '{HI}' THEN 'holdout' END AS split, direction, count(*) AS n
FROM shocks WHERE event_date < '{LO}' OR (as_of >= '{LO}' AND event_date <= '{HI}') GROUP BY 1, 2, 3"""))
def study_shocks_by_split(spark: SparkSession, sf: str) -> DataFrame:
    """The study set's shock windows by split and direction."""
    w = study.study_set(_days(spark, sf), SHOCK, LO, HI).filter("is_shock")
    return w.groupBy("series_id", "split", "direction").agg(F.count(F.lit(1)).alias("n"))


@query("H5 P24")
def study_set(spark: SparkSession, sf: str) -> DataFrame:
    """Shocks and controls by split, three controls per holdout shock."""
    w = study.study_set(_days(spark, sf), SHOCK, LO, HI, holdout_controls=3)
    return w.groupBy("series_id", "split", "is_shock").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("event_date").alias("n_sessions"))


@query("W16 H6", sql("days", """
SELECT series_id, timestamp AS as_of, nxt AS event_date, coalesce(abs(mv) >= 75, false) AS is_shock, round(mv, 6) AS return_pct,
  CASE WHEN abs(mv) >= 75 THEN CASE WHEN mv > 0 THEN 'up' ELSE 'down' END END AS direction
FROM (SELECT *, lead(timestamp) OVER w AS nxt, lead(return_pct) OVER w AS mv FROM days WINDOW w AS (PARTITION BY series_id ORDER BY timestamp)) WHERE nxt IS NOT NULL"""))
def population_windows(spark: SparkSession, sf: str) -> DataFrame:
    """Every session as a window on the next session."""
    return rounded(ev.population_windows(days(spark, sf), SHOCK), 6, "return_pct").select("series_id", "as_of", "event_date", "is_shock", "return_pct", "direction")


_REGIMES = """
, cuts AS (SELECT series_id, timestamp, vol, count(vol) OVER w AS n, quantile_cont(vol, 0.33) OVER w AS lo, quantile_cont(vol, 0.67) OVER w AS hi
  FROM days WINDOW w AS (PARTITION BY series_id ORDER BY timestamp ROWS UNBOUNDED PRECEDING)),
regimes AS (SELECT series_id, timestamp, CASE WHEN vol IS NULL OR n < 252 THEN NULL WHEN vol < lo THEN 'low' WHEN vol > hi THEN 'high' ELSE 'normal' END AS regime FROM cuts)"""


@query("W7", sql("days", _REGIMES + " SELECT series_id, timestamp, regime FROM regimes"))
def volatility_regimes(spark: SparkSession, sf: str) -> DataFrame:
    """Regimes from expanding quantiles of volatility."""
    return ev.volatility_regimes(days(spark, sf)).select("series_id", "timestamp", "regime")


_RULES = _REGIMES + f"""
, w AS (SELECT d.series_id, d.timestamp AS as_of, d.nxt AS event_date, coalesce(abs(d.mv) >= 75, false) AS is_shock, CASE WHEN d.timestamp < '{LO}' AND d.nxt < '{LO}' THEN 'train' WHEN d.timestamp >= '{LO}' AND d.nxt <= '{HI}' THEN 'holdout' END AS split,
    day(d.timestamp) >= 28 AS announced, r.regime
  FROM (SELECT *, lead(timestamp) OVER w AS nxt, lead(return_pct) OVER w AS mv FROM days WINDOW w AS (PARTITION BY series_id ORDER BY timestamp)) d
  JOIN regimes r ON r.series_id = d.series_id AND r.timestamp = d.timestamp WHERE nxt IS NOT NULL),
m AS (SELECT series_id, split, is_shock, unnest(['announcement_after_close', 'high_volatility_regime', 'low_volatility_regime']) AS pattern_id,
    unnest([announced, coalesce(regime = 'high', false), coalesce(regime = 'low', false)]) AS match FROM w WHERE split IS NOT NULL),
c AS (SELECT series_id, pattern_id, split, count(*) AS n_windows, count(*) FILTER (WHERE match) AS n_matches, count(*) FILTER (WHERE match AND is_shock) AS n_hits, count(*) FILTER (WHERE is_shock) AS n_shocks FROM m GROUP BY 1, 2, 3),
b AS (SELECT series_id, CASE WHEN timestamp < '{LO}' THEN 'train' ELSE 'holdout' END AS split, avg(shock::INT) AS base_rate FROM days WHERE timestamp <= '{HI}' GROUP BY 1, 2),
lf AS (SELECT *, n_hits / n_shocks AS sens, (n_matches - n_hits) / (n_windows - n_shocks) AS fmr FROM c),
e AS (SELECT l.*, b.base_rate, CASE WHEN n_matches > 0 THEN sens / (sens * base_rate + fmr * (1 - base_rate)) END AS lift,
  (SELECT sum(exp(lgamma(n_shocks + 1) - lgamma(k + 1) - lgamma(n_shocks - k + 1) + lgamma(n_windows - n_shocks + 1) - lgamma(n_matches - k + 1) - lgamma(n_windows - n_shocks - n_matches + k + 1)
       - lgamma(n_windows + 1) + lgamma(n_matches + 1) + lgamma(n_windows - n_matches + 1)))
     FROM (SELECT unnest(range(greatest(n_hits, n_matches - (n_windows - n_shocks)), least(n_shocks, n_matches) + 1)) AS k)) AS p_value
  FROM lf l JOIN b ON b.series_id = l.series_id AND b.split = l.split)"""


# Lift and p need shocks and other windows, and lift some match in the population; else they are undefined.
_DEFINED = _RULES + """
, d AS (SELECT * REPLACE (CASE WHEN n_shocks > 0 AND n_shocks < n_windows AND sens * base_rate + fmr * (1 - base_rate) > 0 THEN lift END AS lift,
    CASE WHEN n_shocks > 0 AND n_shocks < n_windows THEN p_value END AS p_value) FROM e)"""


def _population(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """All sessions as windows with the rule inputs (a month-end flag and the regime), and the base rates."""
    d = _days(spark, sf)
    w = ev.population_windows(d, SHOCK)
    regimes = ev.volatility_regimes(d).select("series_id", F.col("timestamp").alias("as_of"), "regime")
    flagged = w.join(regimes, ["series_id", "as_of"]).withColumn("announced", F.dayofmonth("as_of") >= 28)
    windows = ev.train_holdout(flagged, LO, HI).filter(F.col("split").isNotNull())
    return windows, ev.base_rates(d, SHOCK, _split())


@query("A30 A31 P26 F11", sql("days", _DEFINED + """
SELECT series_id, pattern_id, split, n_windows, n_matches, n_hits, n_shocks, round(base_rate, 8) AS base_rate, round(lift, 6) AS lift, round(lift * base_rate, 6) AS precision,
  round(CASE WHEN p_value > 1 THEN 1 ELSE p_value END, 6) AS p_value FROM d"""))
def pattern_evidence(spark: SparkSession, sf: str) -> DataFrame:
    """Counts, population lift and exact p of every rule on both splits, in one aggregate."""
    windows, bases = _population(spark, sf)
    m = ev.pattern_metrics(ev.evidence_counts(ev.apply_rules(windows, ev.BUILTIN_RULES)), bases, bootstrap=False)
    out = m.select("series_id", "pattern_id", "split", "n_windows", "n_matches", "n_hits", "n_shocks", "base_rate", "lift", "precision", "p_value")
    return rounded(rounded(out, 6, "lift", "precision", "p_value"), 8, "base_rate")


@query("A32 P21 P23 H6")
def candidate_verdicts(spark: SparkSession, sf: str) -> DataFrame:
    """Bootstrap intervals, gate reasons and verdict of every rule."""
    windows, bases = _population(spark, sf)
    v = study.evaluate_candidates(windows, ev.BUILTIN_RULES, bases)
    return v.select("series_id", "pattern_id", F.round("train_ci_low", 6).alias("train_ci_low"), F.array_join("reasons", ", ").alias("reasons"), "graduates", "why_not")


@query("P21 P23 H6", sql("days", _DEFINED + """
, t AS (SELECT * FROM d WHERE split = 'train'), h AS (SELECT * FROM d WHERE split = 'holdout')
SELECT t.series_id, t.pattern_id, concat_ws(', ', CASE WHEN NOT t.n_matches >= 5 THEN 'train_matches' END, CASE WHEN NOT coalesce(t.lift >= 2, false) THEN 'train_lift' END,
  CASE WHEN NOT coalesce(t.p_value < 0.05, false) THEN 'train_p_value' END, 'train_interval', CASE WHEN h.n_matches = 0 THEN 'holdout_untested' END,
  CASE WHEN h.n_matches > 0 AND NOT coalesce(h.lift >= 1.5, false) THEN 'holdout_lift' END, CASE WHEN h.n_matches > 0 AND NOT coalesce(h.p_value < 0.1, false) THEN 'holdout_p_value' END) AS reasons,
  CASE WHEN coalesce(h.lift >= 1.5 AND h.p_value < 0.1, false) THEN 'real after the cutoff, not before' WHEN h.n_matches = 1 AND h.n_hits = 1 THEN 'one event' ELSE 'no effect' END AS why_not
FROM t JOIN h ON h.series_id = t.series_id AND h.pattern_id = t.pattern_id"""))
def gate_without_interval(spark: SparkSession, sf: str) -> DataFrame:
    """Gate reasons and why-not group when no bootstrap interval was computed (an undefined criterion fails)."""
    windows, bases = _population(spark, sf)
    v = study.evaluate_candidates(windows, ev.BUILTIN_RULES, bases, bootstrap=False)
    return v.select("series_id", "pattern_id", F.array_join("reasons", ", ").alias("reasons"), "why_not")


@query("P22 P21", sql("days", _RULES + """
, t AS (SELECT * FROM e WHERE split = 'train'), h AS (SELECT * FROM e WHERE split = 'holdout')
SELECT t.series_id, t.pattern_id, NOT (t.n_matches >= 5 AND t.lift >= 1.5 AND t.p_value < 0.1 AND h.lift >= 1.0) AS fails_exploratory, coalesce(h.lift >= 1.5 AND h.p_value < 0.1, false) AS passes_screen
FROM t JOIN h ON h.series_id = t.series_id AND h.pattern_id = t.pattern_id"""))
def gate_screens(spark: SparkSession, sf: str) -> DataFrame:
    """The loosened gate and the holdout-only screen."""
    windows, bases = _population(spark, sf)
    m = ev.pattern_metrics(ev.evidence_counts(ev.apply_rules(windows, ev.BUILTIN_RULES)), bases, bootstrap=False)
    wide = ev.side_by_side(m)
    return wide.select("series_id", "pattern_id", (F.size(ev.exploratory_reasons()) > 0).alias("fails_exploratory"), ev.holdout_passes().alias("passes_screen"))


_LABELS = """
, labels_day AS (SELECT CAST(o_orderdate AS DATE) AS day, CASE WHEN count(*) > 6 THEN 'yes' ELSE 'no' END AS answer FROM orders GROUP BY 1)"""


def _labelled(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    windows, bases = _population(spark, sf)
    answers = table(spark, sf, "orders").groupBy(F.to_date("o_orderdate").alias("day")).agg(F.when(F.count(F.lit(1)) > 6, "yes").otherwise("no").alias("answer"))
    return ev.label_rule_matches(windows, answers), bases


@query("P27 U4", sql("days", _RULES + _LABELS + """
SELECT w.series_id, w.as_of, l.answer = 'yes' AS match, l.answer IS NULL AS label_missing FROM w LEFT JOIN labels_day l ON l.day = CAST(w.as_of AS DATE) WHERE w.split IS NOT NULL"""))
def label_rule(spark: SparkSession, sf: str) -> DataFrame:
    """A rule read from stored daily labels; days without a label are flagged."""
    m, _ = _labelled(spark, sf)
    return m.select("series_id", "as_of", "match", "label_missing")


@query("H7")
def screen_then_test(spark: SparkSession, sf: str) -> DataFrame:
    """Every rule, the stored label included, screened on the holdout first; only survivors are tested on train.

    Built-in rules see every window.  The stored label cannot judge a window without one; ``n_unlabelled`` says how many those were.
    """
    m, bases = _labelled(spark, sf)
    m = settled(m.drop("match"), "windows")
    by_label = {"busy_day": lambda w: F.col("answer") == "yes"}
    judged = settled(ev.apply_rules(m, ev.BUILTIN_RULES).unionByName(ev.apply_rules(m.filter(~F.col("label_missing")), by_label)), "judged")
    v = study.screen_then_test(judged.filter("split = 'holdout'"), judged.filter("split = 'train'"), bases)
    without = m.filter("label_missing").groupBy("series_id").agg(F.count(F.lit(1)).alias("_n")).withColumn("pattern_id", F.lit("busy_day"))
    told = v.join(without, ["series_id", "pattern_id"], "left").withColumn("n_unlabelled", F.coalesce("_n", F.lit(0)))
    return told.select("series_id", "pattern_id", "stage", "graduates", "why_not", "n_unlabelled")


@query("A28 J10", sql("days", """
, react AS (SELECT DISTINCT a.series_id, n.timestamp FROM (SELECT series_id, max(timestamp) AS announced_at FROM days GROUP BY 1, date_trunc('month', timestamp)) a
    ASOF JOIN days n ON n.series_id = a.series_id AND a.announced_at < n.timestamp),
f AS (SELECT d.*, coalesce(lag(shock) OVER (PARTITION BY d.series_id ORDER BY d.timestamp), false) AS after_shock, r.timestamp IS NOT NULL AS is_react FROM days d LEFT JOIN react r ON r.series_id = d.series_id AND r.timestamp = d.timestamp),
x AS (SELECT *, unnest(['all sessions', 'no announcement, calm', 'no announcement, normal', 'no announcement, elevated', 'day after a shock', 'announcement reaction']) AS condition,
  unnest([true, NOT is_react AND vol_before < 45, NOT is_react AND vol_before BETWEEN 45 AND 60, NOT is_react AND vol_before > 60, after_shock, is_react]) AS met FROM f)
SELECT series_id, condition, count(*) AS sessions, count(*) FILTER (WHERE shock) AS shocks, count(*) FILTER (WHERE shock AND return_pct > 0) AS up, count(*) FILTER (WHERE shock AND return_pct < 0) AS down, round(avg(shock::INT), 8) AS rate
FROM x WHERE met GROUP BY 1, 2"""))
def anchor_table(spark: SparkSession, sf: str) -> DataFrame:
    """Shock rate under overlapping conditions; announcements fall on each month's last session."""
    d = _days(spark, sf)
    calendar = d.groupBy("series_id", F.trunc(F.to_date("timestamp"), "MM").alias("m")).agg(F.max("timestamp").alias("announced_at")).drop("m")
    return rounded(ev.anchor_table(d, ev.reaction_sessions(calendar, d), SHOCK, 45.0, 60.0), 8, "rate")


# --- forecasts against sessions ---------------------------------------------------------------------


def _price_forecasts(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    p = settled(prices(spark, sf), "prices")
    t = tasks(p.select("series_id"), frequency="B")
    s = specs(t, spec_id="prices", stride=5)
    scored = settled(bt.backtest(p, t, s, FORECASTERS), "scored")
    return scored, settled(ev.sessions(p), "sessions")


_PRICE_SCORED = """
, po AS (SELECT series_id, as_of FROM (SELECT DISTINCT series_id FROM prices), (SELECT d AS as_of FROM (SELECT d, row_number() OVER (ORDER BY d) - 1 AS i FROM unnest(generate_series(TIMESTAMP '1996-01-01', TIMESTAMP '2001-06-30', INTERVAL 1 DAY)) t(d) WHERE isodow(d) < 6) WHERE i % 5 = 0)),
pc AS (SELECT po.series_id, po.as_of, p.value AS last_value, p.k FROM po ASOF JOIN (SELECT *, count(*) OVER (PARTITION BY series_id ORDER BY timestamp) AS k FROM prices) p ON p.series_id = po.series_id AND po.as_of >= p.released_at WHERE p.k >= 30),
pf AS (SELECT pc.*, h.horizon, as_of + to_days(CAST(h.horizon + 2 * floor((isodow(as_of) - 1 + h.horizon) / 5.0) AS INTEGER)) AS forecast_date FROM pc, (SELECT unnest([5, 10, 21]) AS horizon) h),
ps AS (SELECT pf.*, abs(last_value - p.value) AS score FROM pf JOIN prices p ON p.series_id = pf.series_id AND p.timestamp = pf.forecast_date)"""


@query("A36 J9", sql("days", _REGIMES + _PRICE_SCORED + """
, g AS (SELECT ps.*, r.regime FROM (SELECT *, as_of - INTERVAL 1 DAY AS at FROM ps) ps ASOF LEFT JOIN regimes r ON r.series_id = ps.series_id AND ps.at >= r.timestamp)
SELECT regime, count(*) AS n, round(avg(score), 5) AS mean_score FROM g GROUP BY 1"""))
def score_by_regime(spark: SparkSession, sf: str) -> DataFrame:
    """Naive score by the regime in force the day before each origin."""
    scored, d = _price_forecasts(spark, sf)
    naive = scored.filter("predictor_id = 'last_value_naive'")
    regimes = ev.volatility_regimes(d).select("series_id", "timestamp", "regime")
    g = ev.regime_before(naive.select("series_id", "as_of", "score"), regimes)
    return g.groupBy("regime").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("score"), 5).alias("mean_score"))


@query("A36 J11", sql("days", _PRICE_SCORED + """
, g AS (SELECT ps.*, EXISTS (SELECT 1 FROM days d WHERE d.shock AND d.series_id = ps.series_id AND d.timestamp BETWEEN ps.as_of AND ps.forecast_date) AS shock_in_window FROM ps)
SELECT horizon, shock_in_window, count(*) AS n, round(avg(score), 5) AS mean_score FROM g GROUP BY 1, 2"""))
def score_by_shock_in_window(spark: SparkSession, sf: str) -> DataFrame:
    """Naive score by whether a shock fell inside the forecast window (range exists, by counting)."""
    scored, d = _price_forecasts(spark, sf)
    naive = scored.filter("predictor_id = 'last_value_naive'").select("series_id", "as_of", "forecast_date", "horizon", "score")
    g = ev.shock_in_window(naive, d, SHOCK)
    return g.groupBy("horizon", "shock_in_window").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("score"), 5).alias("mean_score"))


def _arms(spark: SparkSession, sf: str) -> DataFrame:
    obs, t, s = shock_setup(spark, sf)
    arms = {"all": fc.historical_frequency, "recent": lambda c, o: fc.historical_frequency(c, o, 50)}
    return settled(bt.backtest(obs, t, s, arms), "arms")


_ARMS = _SHOCK_ORIGINS + """
, v AS (SELECT series_id, as_of, value, row_number() OVER (PARTITION BY series_id, as_of ORDER BY timestamp DESC) AS r, count(*) OVER (PARTITION BY series_id, as_of) AS n FROM so JOIN flags USING (series_id) WHERE released_at <= as_of),
p AS (SELECT series_id, as_of, avg(value) AS a, avg(value) FILTER (WHERE r <= 50) AS b FROM v WHERE n >= 60 GROUP BY 1, 2),
arms AS (SELECT p.series_id, p.as_of, f.value AS y, unnest(['historical_frequency', 'historical_frequency_50']) AS predictor_id, unnest([a, b]) AS probability
  FROM p JOIN flags f ON f.series_id = p.series_id AND f.timestamp = p.as_of + to_days(CAST(CASE isodow(p.as_of) WHEN 5 THEN 3 ELSE 1 END AS INTEGER)))"""


@query("A35", sql("prices", _ARMS + """
SELECT predictor_id, count(*) AS n, CAST(sum(y) AS BIGINT) AS shocks, round(avg((probability - y) * (probability - y)), 8) AS brier, round(avg(probability) FILTER (WHERE y = 1), 8) AS p_before_shock,
  round(avg(probability) FILTER (WHERE y = 0), 8) AS p_before_calm, round(avg(probability) FILTER (WHERE y = 1) - avg(probability) FILTER (WHERE y = 0), 8) AS separation FROM arms GROUP BY 1""").replace(")\n\n,", "),\n"))
def arm_summary(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(an.arm_summary(_arms(spark, sf).withColumn("outcome", F.col("actual"))), 8, "brier", "p_before_shock", "p_before_calm", "separation")


@query("A33 J16", sql("prices", _ARMS + f"""
, s AS (SELECT 'next_' || series_id AS task_id, as_of, predictor_id, probability, y, (probability - y) * (probability - y) AS score FROM arms),
board AS (SELECT task_id, predictor_id, count(*) AS n, CAST(sum(y) AS BIGINT) AS shocks, avg(score) AS brier, avg(probability) FILTER (WHERE y = 1) AS up, avg(probability) FILTER (WHERE y = 0) AS down FROM s GROUP BY 1, 2),
diffs AS (SELECT m.task_id, m.predictor_id, m.score - r.score AS diff, ('0x' || substr(md5(m.task_id || '|' || m.predictor_id || '|' || m.as_of::VARCHAR), 1, 8))::BIGINT % {bs.PRIME} AS draw
  FROM s m JOIN s r ON r.task_id = m.task_id AND r.as_of = m.as_of AND r.predictor_id = 'historical_frequency' WHERE m.predictor_id <> 'historical_frequency'),
drawn AS (SELECT *, {bs.weight_sql("draw", "b")} AS w FROM diffs, (SELECT unnest(range(0, {bs.RESAMPLES})) AS b)),
means AS (SELECT task_id, predictor_id, b, sum(w * diff) / sum(w) AS m FROM drawn GROUP BY 1, 2, 3 HAVING sum(w) > 0),
bands AS (SELECT task_id, predictor_id, quantile_cont(m, 0.05) AS lo, quantile_cont(m, 0.95) AS hi FROM means GROUP BY 1, 2)
SELECT b.task_id, b.predictor_id, b.n, b.shocks, round(b.brier, 6) AS brier, round(b.up, 6) AS mean_p_shock, round(b.down, 6) AS mean_p_calm, round(b.up - b.down, 6) AS separation,
  CASE WHEN r.brier > 0 THEN round(1 - b.brier / r.brier, 6) END AS brier_skill, round(lo, 6) AS diff_lo, round(hi, 6) AS diff_hi
FROM board b LEFT JOIN board r ON r.task_id = b.task_id AND r.predictor_id = 'historical_frequency' LEFT JOIN bands d ON d.task_id = b.task_id AND d.predictor_id = b.predictor_id"""))
def paired_brier_board(spark: SparkSession, sf: str) -> DataFrame:
    """Brier skill, separation and paired bootstrap interval against climatology, per series."""
    board = ev.brier_board(_arms(spark, sf), "historical_frequency", ("task_id",))
    return rounded(board, 6, "brier", "mean_p_shock", "mean_p_calm", "separation", "brier_skill", "diff_lo", "diff_hi")


@query("J14 J15 F25", sql("prices", _ARMS + """
, q AS (SELECT *, predictor_id = 'historical_frequency' AND round(probability * 100, 2) % 1 < 0.2 AS leaked FROM arms), bad AS (SELECT DISTINCT series_id, as_of FROM q WHERE leaked)
SELECT predictor_id, count(*) AS n FROM q WHERE NOT EXISTS (SELECT 1 FROM bad WHERE bad.series_id = q.series_id AND bad.as_of = q.as_of) GROUP BY 1""").replace(")\n\n,", "),\n"))
def leaked_origins_dropped(spark: SparkSession, sf: str) -> DataFrame:
    """An origin leaked in one arm leaves all arms; only origins shared by all arms count."""
    arms = _arms(spark, sf).withColumn("leaked", (F.col("predictor_id") == "historical_frequency") & (F.round(F.col("probability") * 100, 2) % 1 < 0.2))
    kept = an.shared_origins(ev.drop_leaked(arms, keys=("task_id",)), ("task_id",))
    return kept.groupBy("predictor_id").agg(F.count(F.lit(1)).alias("n"))


@query("F25", """
SELECT event_id, contains(printf('%.2f %s', value + 0.01, props), printf('%.2f', value)) OR contains(printf('%.2f %s', value + 0.01, props), printf('%.2f', value + 0.01)) OR contains(printf('%.2f %s', value + 0.01, props), printf('%.2f', value - 0.01)) AS quoted FROM events""")
def quoted_values(spark: SparkSession, sf: str) -> DataFrame:
    """Does a record quote a value to the cent, give or take one?"""
    e = table(spark, sf, "events").withColumn("record", F.format_string("%.2f %s", F.col("value") + 0.01, F.col("props")))
    return e.select("event_id", ev.quotes_value(F.col("record"), F.col("value")).alias("quoted"))


@query("F10", "SELECT 0 AS x".replace("SELECT 0 AS x", "SELECT user_id, count(*) AS n, CAST(0 AS BIGINT) AS n_out_of_range, CAST(count(*) FILTER (WHERE z > 0) AS BIGINT) AS n_above_half FROM (SELECT user_id, (value - 20) / 10 AS z FROM events) GROUP BY 1"))
def normal_cdf_sides(spark: SparkSession, sf: str) -> DataFrame:
    """Normal CDF of every standardised event value: inside (0, 1), above one half exactly when positive."""
    e = table(spark, sf, "events").select("user_id", ((F.col("value") - 20) / 10).alias("z"))
    p = e.withColumn("p", stats.normal_cdf(F.col("z")))
    return p.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.count_if((F.col("p") < 0) | (F.col("p") > 1)).alias("n_out_of_range"), F.count_if(F.col("p") > 0.5).alias("n_above_half"))


