"""Calendar functions, projections, window features and resampling."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.functions import calendar as cal
from tidemark.operators import features as ft, ordered
from tidemark.queries.registry import query
from tidemark.queries.tables import bday, bday_number, monthly, observations, prices, rounded, sql, step_rates, table

KEY = ["series_id"]


# --- calendar arithmetic over every order date ------------------------------------------------


@query("F1 F2 F7", f"""
SELECT o_orderdate AS ts, o_orderdate + INTERVAL 20 HOUR + to_days(3) AS d3,
  {bday("(o_orderdate + INTERVAL 20 HOUR)", 1)} AS b1, {bday("(o_orderdate + INTERVAL 20 HOUR)", 7)} AS b7,
  date_trunc('month', o_orderdate) + INTERVAL 2 MONTH + INTERVAL 20 HOUR AS ms2,
  o_orderdate + INTERVAL 20 HOUR + to_days(CAST(CASE WHEN isodow(o_orderdate) = 7 THEN 14 ELSE 7 - isodow(o_orderdate) + 7 END AS INTEGER)) AS w2,
  o_orderdate + INTERVAL 25 HOUR AS h5, o_orderdate + INTERVAL 16 HOUR AS close_at
FROM (SELECT DISTINCT o_orderdate FROM orders)""")
def add_periods(spark: SparkSession, sf: str) -> DataFrame:
    """Every frequency's step from an after-close stamp on every order date; time of day is kept."""
    d = table(spark, sf, "orders").select(F.col("o_orderdate").alias("ts")).distinct().withColumn("at", cal.at_hour("ts", 20))
    return d.select(
        "ts", cal.add_periods("at", "D", 3).alias("d3"), cal.add_periods("at", "B", 1).alias("b1"), cal.add_periods("at", "B", 7).alias("b7"),
        cal.add_periods("at", "MS", 2).alias("ms2"), cal.add_periods("at", "W", 2).alias("w2"), cal.add_periods("at", "h", 5).alias("h5"),
        cal.at_hour("ts", 16).alias("close_at"),
    )


@query("F3 F6", f"""
SELECT l_orderkey, l_linenumber, l_partkey, o_orderdate AS a, l_shipdate AS b,
  CAST(greatest({bday_number("(l_shipdate + INTERVAL 1 DAY)")} - {bday_number("o_orderdate")} - 1, 0) AS INTEGER) AS business_days,
  CAST((year(l_shipdate) - year(o_orderdate)) * 12 + month(l_shipdate) - month(o_orderdate) AS INTEGER) AS months
FROM lineitem JOIN orders ON l_orderkey = o_orderkey""")
def calendar_distances(spark: SparkSession, sf: str) -> DataFrame:
    """Business-day and month distance from order to shipping, for every line."""
    j = table(spark, sf, "lineitem").join(table(spark, sf, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return j.select(
        "l_orderkey", "l_linenumber", "l_partkey", F.col("o_orderdate").alias("a"), F.col("l_shipdate").alias("b"),
        cal.business_days_between("o_orderdate", "l_shipdate").alias("business_days"), cal.months_between_labels("o_orderdate", "l_shipdate").alias("months"),
    )


_ME = "(CASE WHEN d = last_day(d) THEN last_day(d + INTERVAL 1 MONTH) ELSE last_day(d) END)::TIMESTAMP"


@query("F4", f"SELECT d AS ts, {_ME} AS month_end, {bday('(' + _ME + ')', 10)} AS released_at FROM (SELECT DISTINCT o_orderdate AS d FROM orders)")
def month_end_release(spark: SparkSession, sf: str) -> DataFrame:
    """Month-end offset plus ten business days; a month-end input moves to the next month end."""
    d = table(spark, sf, "orders").select(F.col("o_orderdate").alias("ts")).distinct()
    return d.select("ts", cal.add_month_end("ts").alias("month_end"), cal.month_end_release("ts").alias("released_at"))


@query("C1", """
WITH spans AS (SELECT o_orderpriority AS series_id, min(o_orderdate) AS a, max(o_orderdate) AS b FROM orders GROUP BY 1),
g AS (SELECT series_id, 'B' AS frequency, d FROM spans, unnest(generate_series(a, b, INTERVAL 1 DAY)) t(d) WHERE isodow(d) < 6
      UNION ALL SELECT series_id, 'MS', d FROM spans, unnest(generate_series(a, b, INTERVAL 1 DAY)) t(d) WHERE day(d) = 1
      UNION ALL SELECT series_id, 'W', d FROM spans, unnest(generate_series(a, b, INTERVAL 1 DAY)) t(d) WHERE isodow(d) = 7)
SELECT series_id, frequency, d AS as_of FROM (SELECT *, row_number() OVER (PARTITION BY series_id, frequency ORDER BY d) - 1 AS i FROM g) WHERE i % 3 = 0""")
def strided_origins(spark: SparkSession, sf: str) -> DataFrame:
    """Every third grid date of each series' span on three frequencies."""
    spans = table(spark, sf, "orders").groupBy(F.col("o_orderpriority").alias("series_id")).agg(F.min("o_orderdate").alias("start"), F.max("o_orderdate").alias("end"))
    specs = spans.withColumn("frequency", F.explode(F.array(F.lit("B"), F.lit("MS"), F.lit("W")))).withColumn("stride", F.lit(3)).withColumn(
        "origin_dates", F.lit(None).cast("array<timestamp_ntz>")
    )
    return cal.origins(specs).select("series_id", "frequency", "as_of")


@query("C1", "SELECT DISTINCT o_orderpriority AS series_id, o_orderdate AS as_of FROM orders")
def explicit_origins(spark: SparkSession, sf: str) -> DataFrame:
    """An explicit origin list (collected per spec, in order) wins over the grid."""
    dates = table(spark, sf, "orders").groupBy(F.col("o_orderpriority").alias("series_id")).agg(F.collect_set("o_orderdate").alias("origin_dates"))
    specs = dates.withColumn("start", cal.ntz("1990-01-01")).withColumn("end", cal.ntz("2002-01-01")).withColumn("stride", F.lit(1)).withColumn("frequency", F.lit("D"))
    return cal.origins(specs).select("series_id", "as_of")


@query("C5", """
SELECT series_id, d AS monday FROM (SELECT o_orderpriority AS series_id, min(o_orderdate) AS a, max(o_orderdate) AS b FROM orders GROUP BY 1),
unnest(generate_series(a, b, INTERVAL 1 DAY)) t(d) WHERE isodow(d) = 1""")
def mondays(spark: SparkSession, sf: str) -> DataFrame:
    spans = table(spark, sf, "orders").groupBy(F.col("o_orderpriority").alias("series_id")).agg(F.min("o_orderdate").alias("a"), F.max("o_orderdate").alias("b"))
    return spans.select("series_id", F.explode(cal.mondays("a", "b")).alias("monday"))


@query("C7", f"SELECT ts, unnest([1, 2, 3, 4, 5]) AS step, unnest([{', '.join(bday('ts', i) for i in range(1, 6))}]) AS ahead FROM (SELECT DISTINCT o_orderdate AS ts FROM orders)")
def business_days_ahead(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "orders").select(F.col("o_orderdate").alias("ts")).distinct()
    return d.select("ts", F.posexplode(cal.business_days_ahead("ts", 5)).alias("step", "ahead")).withColumn("step", F.col("step") + 1)


@query("C6", sql("obs", "SELECT series_id, timestamp, CAST(row_number() OVER (PARTITION BY series_id ORDER BY timestamp) AS BIGINT) AS idx FROM obs"))
def session_index(spark: SparkSession, sf: str) -> DataFrame:
    return ordered.row_index(observations(spark, sf).select("series_id", "timestamp"), KEY, "timestamp")


# --- projections -----------------------------------------------------------------------------------


@query("P5 P7", sql("obs", f"SELECT series_id, timestamp, value, {bday('timestamp', 1)} AS released_at FROM obs WHERE isodow(timestamp) < 6"))
def weekday_levels(spark: SparkSession, sf: str) -> DataFrame:
    """Weekday rows as level features known on the next business day."""
    return ft.level(ft.drop_weekends(observations(spark, sf)))


@query("P8", sql("prices", "SELECT series_id, timestamp, value, timestamp + INTERVAL 16 HOUR AS released_at FROM prices"))
def close_release(spark: SparkSession, sf: str) -> DataFrame:
    return ft.released_at_close(prices(spark, sf)).select(*ft.CANONICAL)


# --- lags and returns --------------------------------------------------------------------------------


@query("W1 P6 F8", sql("prices", f"""
SELECT series_id, timestamp, round(ln(value / prev), 8) AS value, {bday('timestamp', 1)} AS released_at
FROM (SELECT *, lag(value) OVER (PARTITION BY series_id ORDER BY timestamp) AS prev FROM prices WHERE value > 0) WHERE prev IS NOT NULL"""))
def log_returns(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(ft.log_returns(prices(spark, sf)), 8, "value")


@query("W2", sql("prices", """
SELECT series_id || '_' || k || 'b' AS series_id, timestamp, round(ln(value / p), 8) AS value, timestamp AS released_at FROM (
  SELECT series_id, timestamp, value, unnest([1, 5, 10, 21]) AS k, unnest([lag(value, 1) OVER w, lag(value, 5) OVER w, lag(value, 10) OVER w, lag(value, 21) OVER w]) AS p
  FROM prices WINDOW w AS (PARTITION BY series_id ORDER BY timestamp)) WHERE p IS NOT NULL"""))
def cumulative_returns(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(ft.cumulative_log_returns(prices(spark, sf), (1, 5, 10, 21)), 8, "value")


@query("W3", sql("obs", """
SELECT series_id, timestamp, prev AS value, timestamp AS released_at
FROM (SELECT *, lag(value) OVER (PARTITION BY series_id ORDER BY timestamp) AS prev FROM obs) WHERE prev IS NOT NULL"""))
def feature_lag(spark: SparkSession, sf: str) -> DataFrame:
    return ft.feature_lag(observations(spark, sf))


@query("W4 P16", sql("prices", """
SELECT series_id, timestamp, CASE WHEN abs((value / prev - 1) * 100) >= 75 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS value, released_at
FROM (SELECT *, lag(value, 3) OVER (PARTITION BY series_id ORDER BY timestamp) AS prev FROM prices) WHERE prev IS NOT NULL"""))
def shock_indicator(spark: SparkSession, sf: str) -> DataFrame:
    """0/1 series of three-session moves of at least 75 %."""
    return ft.shock_indicator(prices(spark, sf), 75.0, 3)


@query("W5", sql("monthly", """
SELECT series_id, timestamp, round((value / prev - 1) * 100, 6) AS yoy_pct
FROM (SELECT *, lag(value, 12) OVER (PARTITION BY series_id ORDER BY timestamp) AS prev FROM monthly) WHERE prev IS NOT NULL"""))
def year_on_year(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(ft.year_on_year(monthly(spark, sf)), 6, "yoy_pct").select("series_id", "timestamp", "yoy_pct")


@query("W6", sql("days", "SELECT series_id, timestamp, round(vol_before, 6) AS vol_before FROM days"))
def rolling_volatility(spark: SparkSession, sf: str) -> DataFrame:
    """Deviation of the 21 returns before each session, null until they exist."""
    r = ft.percent_change(prices(spark, sf), 1)
    return rounded(ft.rolling_std(r, "return_pct", 21, "vol_before", shift=1), 6, "vol_before").select("series_id", "timestamp", "vol_before")


@query("W9 W21", sql("rates", """
SELECT series_id, timestamp, value, previous FROM (
  SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY timestamp DESC) AS r FROM (
    SELECT *, lag(value) OVER (PARTITION BY series_id ORDER BY timestamp) AS previous FROM rates) WHERE previous IS NOT NULL AND value <> previous) WHERE r <= 40"""))
def last_change_points(spark: SparkSession, sf: str) -> DataFrame:
    """The last 40 steps of each step series with the level before."""
    from pyspark.sql import Window

    changes = ft.change_points(step_rates(spark, sf))
    newest = Window.partitionBy("series_id").orderBy(F.col("timestamp").desc())
    return changes.withColumn("r", F.row_number().over(newest)).filter("r <= 40").select("series_id", "timestamp", "value", "previous")


@query("W13 C2", sql("prices", """
SELECT g.series_id, g.d AS timestamp, last_value(p.value IGNORE NULLS) OVER (PARTITION BY g.series_id ORDER BY g.d ROWS UNBOUNDED PRECEDING) AS value, g.d AS released_at
FROM (SELECT series_id, d FROM (SELECT series_id, min(timestamp) AS a, max(timestamp) AS b FROM prices GROUP BY 1), unnest(generate_series(a, b, INTERVAL 1 DAY)) t(d) WHERE isodow(d) < 6) g
LEFT JOIN prices p ON p.series_id = g.series_id AND p.timestamp = g.d"""))
def business_daily_fill(spark: SparkSession, sf: str) -> DataFrame:
    return ft.business_daily_fill(prices(spark, sf))


@query("W14 C4", sql("filled", "SELECT series_id, timestamp, round(value, 9) AS value FROM filled"))
def interpolated_grid(spark: SparkSession, sf: str) -> DataFrame:
    """Full daily grid with gaps on the line between neighbours."""
    return rounded(ft.fill_gaps(observations(spark, sf), "D"), 9, "value")


_EXPAND = """
SELECT g.series_id, g.d AS timestamp, last_value(r.value IGNORE NULLS) OVER (PARTITION BY g.series_id ORDER BY g.d ROWS UNBOUNDED PRECEDING) AS value
FROM (SELECT series_id, d FROM (SELECT series_id, {hi} AS b FROM monthly GROUP BY 1), unnest(generate_series(TIMESTAMP '1996-01-01', b, INTERVAL 1 DAY)) t(d) WHERE isodow(d) < 6) g
LEFT JOIN {rel} r ON r.series_id = g.series_id AND r.rel = g.d"""


@query("C3", sql("monthly", "SELECT *, timestamp AS released_at FROM (" + _EXPAND.format(
    hi=bday("max(released_at)", 1), rel="(SELECT series_id, released_at AS rel, arg_max(value, timestamp) AS value FROM monthly GROUP BY 1, 2)") + ") WHERE value IS NOT NULL"))
def release_driven_expansion(spark: SparkSession, sf: str) -> DataFrame:
    """Monthly values on the business day they are released, carried forward; earlier releases never appear."""
    return ft.expand_from_releases(monthly(spark, sf), "1996-01-01")


@query("C3", sql("monthly", "SELECT *, timestamp AS released_at FROM (" + _EXPAND.format(
    hi=bday("max(released_at)", 1), rel="(SELECT series_id, greatest(released_at, TIMESTAMP '1996-01-01') AS rel, arg_max(value, timestamp) AS value FROM monthly GROUP BY 1, 2)") + ") WHERE value IS NOT NULL"))
def release_expansion_carry_in(spark: SparkSession, sf: str) -> DataFrame:
    """The same, with releases from before the start carried in."""
    return ft.expand_from_releases(monthly(spark, sf), "1996-01-01", carry_in=True)


@query("W16 W17", sql("days", """
SELECT series_id, timestamp, lead(return_pct) OVER w IS NOT NULL AND abs(lead(return_pct) OVER w) >= 75 AS next_shock, coalesce(lag(shock) OVER w, false) AS after_shock
FROM days WINDOW w AS (PARTITION BY series_id ORDER BY timestamp)"""))
def neighbour_flags(spark: SparkSession, sf: str) -> DataFrame:
    """Shock on the next session and on the previous one."""
    from tidemark.operators import events as ev
    from tidemark.queries.tables import SHOCK, days

    d = days(spark, sf).withColumn("shock", ev.is_shock(SHOCK))
    nxt = ordered.leads(d, KEY, "timestamp", {"_n": ("shock", 1)})
    both = ordered.lags(nxt, KEY, "timestamp", {"_p": ("shock", 1)})
    return both.select("series_id", "timestamp", F.coalesce("_n", F.lit(False)).alias("next_shock"), F.coalesce("_p", F.lit(False)).alias("after_shock"))


@query("W18", sql("decisions", "SELECT series_id, timestamp, value, lag(value) OVER (PARTITION BY series_id ORDER BY timestamp) AS prior_value FROM decisions"))
def prior_outcome(spark: SparkSession, sf: str) -> DataFrame:
    from tidemark.queries.tables import decisions

    return ordered.lags(decisions(spark, sf), KEY, "timestamp", {"prior_value": ("value", 1)}).select("series_id", "timestamp", "value", "prior_value")


# --- several series -------------------------------------------------------------------------------------


def _pairs(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        [("urgent_vs_low", "1-URGENT", "5-LOW"), ("high_vs_medium", "2-HIGH", "3-MEDIUM")], "series_id string, numerator string, denominator string"
    )


_PAIRS = "(VALUES ('urgent_vs_low', '1-URGENT', '5-LOW'), ('high_vs_medium', '2-HIGH', '3-MEDIUM')) p(series_id, numerator, denominator)"


@query("J12", sql("obs", f"""
SELECT p.series_id, a.timestamp, round(a.value - b.value, 6) AS value FROM {_PAIRS}
JOIN obs a ON a.series_id = p.numerator JOIN obs b ON b.series_id = p.denominator AND a.timestamp = b.timestamp"""))
def spread(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(ft.spread(observations(spark, sf), _pairs(spark)), 6, "value")


@query("J12 W13 W3", sql("obs", f"""
SELECT series_id, timestamp, round(prev, 8) AS value, timestamp AS released_at FROM (
  SELECT *, lag(value) OVER (PARTITION BY series_id ORDER BY timestamp) AS prev FROM (
    SELECT g.series_id, g.d AS timestamp, last_value(r.value IGNORE NULLS) OVER (PARTITION BY g.series_id ORDER BY g.d ROWS UNBOUNDED PRECEDING) AS value
    FROM (SELECT series_id, d FROM (SELECT p.series_id, min(a.timestamp) AS lo, max(a.timestamp) AS hi FROM {_PAIRS} JOIN obs a ON a.series_id = p.numerator JOIN obs b ON b.series_id = p.denominator AND a.timestamp = b.timestamp GROUP BY 1),
          unnest(generate_series(lo, hi, INTERVAL 1 DAY)) t(d) WHERE isodow(d) < 6) g
    LEFT JOIN (SELECT p.series_id, a.timestamp, ln(a.value / b.value) AS value FROM {_PAIRS} JOIN obs a ON a.series_id = p.numerator JOIN obs b ON b.series_id = p.denominator AND a.timestamp = b.timestamp) r
      ON r.series_id = g.series_id AND r.timestamp = g.d) WHERE value IS NOT NULL) WHERE prev IS NOT NULL"""))
def log_ratio(spark: SparkSession, sf: str) -> DataFrame:
    """Log ratio on shared dates, filled over business days and lagged a row."""
    return rounded(ft.log_ratio(observations(spark, sf), _pairs(spark)), 8, "value")


@query("J13", sql("obs", """
SELECT timestamp, first(value) FILTER (WHERE series_id = '1-URGENT') AS urgent, first(value) FILTER (WHERE series_id = '2-HIGH') AS high, first(value) FILTER (WHERE series_id = '5-LOW') AS low
FROM obs WHERE series_id IN ('1-URGENT', '2-HIGH', '5-LOW')
  AND timestamp BETWEEN (SELECT max(a) FROM (SELECT min(timestamp) AS a FROM obs WHERE series_id IN ('1-URGENT', '2-HIGH', '5-LOW') GROUP BY series_id))
                    AND (SELECT min(b) FROM (SELECT max(timestamp) AS b FROM obs WHERE series_id IN ('1-URGENT', '2-HIGH', '5-LOW') GROUP BY series_id))
GROUP BY 1"""))
def covariate_panel(spark: SparkSession, sf: str) -> DataFrame:
    wide = ft.covariate_panel(observations(spark, sf), ["1-URGENT", "2-HIGH", "5-LOW"])
    return wide.select("timestamp", F.col("`1-URGENT`").alias("urgent"), F.col("`2-HIGH`").alias("high"), F.col("`5-LOW`").alias("low"))


def _fill(src: str, where: str = "") -> str:
    return f"""SELECT g.series_id, g.d AS timestamp, last_value(p.value IGNORE NULLS) OVER (PARTITION BY g.series_id ORDER BY g.d ROWS UNBOUNDED PRECEDING) AS value
    FROM (SELECT series_id, d FROM (SELECT series_id, min(timestamp) AS a, max(timestamp) AS b FROM {src} GROUP BY 1), unnest(generate_series(a, b, INTERVAL 1 DAY)) t(d) WHERE isodow(d) < 6) g
    LEFT JOIN {src} p ON p.series_id = g.series_id AND p.timestamp = g.d"""


@query("C8 H4 C9", sql("prices obs", f"""
, wk AS (SELECT * FROM obs WHERE isodow(timestamp) < 6), f AS ({_fill('wk')}), pf AS ({_fill('prices')}),
lv AS (SELECT series_id || '_level' AS series_id, timestamp, value FROM f),
rt AS (SELECT series_id || '_return' AS series_id, timestamp, ln(value / prev) AS value FROM (SELECT *, lag(value) OVER (PARTITION BY series_id ORDER BY timestamp) AS prev FROM f) WHERE prev IS NOT NULL),
u AS (SELECT * FROM lv UNION ALL SELECT * FROM rt)
SELECT series_id, count(*) AS n, round(avg(value), 6) AS mean, min(timestamp) AS first, max(timestamp) AS last FROM (
  SELECT series_id, timestamp, lag(value) OVER (PARTITION BY series_id ORDER BY timestamp) AS value FROM u) WHERE value IS NOT NULL GROUP BY 1""").replace(") \n, wk", "),\nwk").replace(")\n, wk", "),\nwk"))
def covariates_from_recipes(spark: SparkSession, sf: str) -> DataFrame:
    """A registry of covariates built from recipes: filled levels and returns, each lagged a row."""
    obs = observations(spark, sf)
    ids = obs.select(F.col("series_id").alias("source_id")).distinct()
    registry = ids.withColumn("recipe", F.explode(F.array(F.lit("daily_level"), F.lit("daily_return")))).withColumn(
        "series_id", F.concat("source_id", F.when(F.col("recipe") == "daily_level", "_level").otherwise("_return"))
    )
    built = ft.build_covariates(obs, registry)
    return built.groupBy("series_id").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 6).alias("mean"), F.min("timestamp").alias("first"), F.max("timestamp").alias("last")
    )
