"""Series, calendars and forecasts derived from the given tables, in Spark and in SQL.

Each ``CTE`` states in SQL what the function of the same name builds on Spark.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tidemark.functions import calendar as cal, scoring as sc
from tidemark.operators import events as ev, features as ft, forecast as fc
from tidemark.plans import backtest as bt
from tidemark.session import settled

CTE: dict[str, tuple[tuple[str, ...], str]] = {}


def cte(name: str, needs: str, body: str) -> None:
    CTE[name] = (tuple(needs.split()), body)


def sql(needs: str, body: str, *, recursive: bool = False) -> str:
    """``WITH`` the named blocks (and what they need, once each) in front of ``body``."""
    done: list[str] = []

    def visit(name: str) -> None:
        if name in done:
            return
        for n in CTE[name][0]:
            visit(n)
        done.append(name)

    for n in needs.split():
        visit(n)
    return ("WITH RECURSIVE " if recursive else "WITH ") + ",\n".join(f"{n} AS ({CTE[n][1]})" for n in done) + "\n" + body


def bday(expr: str, n: int) -> str:
    """SQL for adding ``n > 0`` business days."""
    dow = f"(isodow({expr}) - 1)"
    days = f"(CASE WHEN {dow} > 4 THEN 4 - {dow} ELSE 0 END + {n} + 2 * floor((least({dow}, 4) + {n}) / 5.0))"
    return f"({expr} + to_days(CAST({days} AS INTEGER)))"


def bday_number(expr: str) -> str:
    days = f"date_diff('day', DATE '1970-01-05', CAST({expr} AS DATE))"
    return f"(floor({days} / 7.0) * 5 + least({days} % 7, 5))"


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def rounded(df: DataFrame, digits: int, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c), digits) for c in columns})


# --- observations -------------------------------------------------------------------


def observations(spark: SparkSession, sf: str) -> DataFrame:
    """Daily order value per priority, published three weeks later."""
    daily = table(spark, sf, "orders").groupBy(F.col("o_orderpriority").alias("series_id"), F.col("o_orderdate").alias("timestamp")).agg(
        (F.round(F.sum("o_totalprice"), 2) / 1000).alias("value")
    )
    return ft.released_after_days(daily, 21)


cte("obs", "", """
  SELECT o_orderpriority AS series_id, o_orderdate AS timestamp, round(sum(o_totalprice), 2) / 1000 AS value,
         o_orderdate + INTERVAL 21 DAY AS released_at
  FROM orders GROUP BY 1, 2""")


# the full daily grid of the observations, gaps on the line between neighbours
cte("filled", "obs", """
  SELECT series_id, timestamp, i, CASE WHEN v IS NOT NULL THEN v ELSE lo + (hi - lo) * (i - loi) / (hii - loi) END AS value, v IS NOT NULL AS own FROM (
    SELECT *, last_value(v IGNORE NULLS) OVER b AS lo, last_value(CASE WHEN v IS NOT NULL THEN i END IGNORE NULLS) OVER b AS loi,
           first_value(v IGNORE NULLS) OVER f AS hi, first_value(CASE WHEN v IS NOT NULL THEN i END IGNORE NULLS) OVER f AS hii
    FROM (SELECT g.series_id, g.d AS timestamp, o.value AS v, row_number() OVER (PARTITION BY g.series_id ORDER BY g.d) AS i
          FROM (SELECT series_id, d FROM (SELECT series_id, min(timestamp) AS a, max(timestamp) AS b FROM obs GROUP BY 1), unnest(generate_series(a, b, INTERVAL 1 DAY)) t(d)) g
          LEFT JOIN obs o ON o.series_id = g.series_id AND o.timestamp = g.d)
    WINDOW b AS (PARTITION BY series_id ORDER BY i ROWS UNBOUNDED PRECEDING), f AS (PARTITION BY series_id ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))""")


def monthly(spark: SparkSession, sf: str) -> DataFrame:
    """Monthly order value per priority, stamped at the month start and published at month end plus ten business days."""
    m = table(spark, sf, "orders").groupBy(F.col("o_orderpriority").alias("series_id"), cal.month_start("o_orderdate").alias("timestamp")).agg(
        (F.round(F.sum("o_totalprice"), 2) / 1000).alias("value")
    )
    return ft.released_after_month_end(m)


_END = "(date_trunc('month', timestamp) + INTERVAL 1 MONTH - INTERVAL 1 DAY)"
cte("monthly_raw", "", """
  SELECT o_orderpriority AS series_id, CAST(date_trunc('month', o_orderdate) AS TIMESTAMP) AS timestamp,
         round(sum(o_totalprice), 2) / 1000 AS value
  FROM orders GROUP BY 1, 2""")
cte("monthly", "monthly_raw", f"SELECT *, CAST({bday(_END, 10)} AS TIMESTAMP) AS released_at FROM monthly_raw")


def prices(spark: SparkSession, sf: str) -> DataFrame:
    """Average unit price per return flag and ship date, weekdays only, known the next business day."""
    li = table(spark, sf, "lineitem").filter(cal.is_weekday("l_shipdate"))
    daily = li.groupBy(F.col("l_returnflag").alias("series_id"), F.col("l_shipdate").alias("timestamp")).agg(
        F.round(F.round(F.sum("l_extendedprice"), 2) / F.sum("l_quantity"), 6).alias("value")
    )
    return ft.next_business_day_release(daily)


cte("prices", "", f"""
  SELECT l_returnflag AS series_id, l_shipdate AS timestamp,
         round(round(sum(l_extendedprice), 2) / sum(l_quantity), 6) AS value, {bday('l_shipdate', 1)} AS released_at
  FROM lineitem WHERE isodow(l_shipdate) < 6 GROUP BY 1, 2""")


def step_rates(spark: SparkSession, sf: str) -> DataFrame:
    """Daily step series: a level per priority and month, held over that month's order dates; visible next day."""
    orders = table(spark, sf, "orders").select(F.col("o_orderpriority").alias("series_id"), F.col("o_orderdate").alias("timestamp"))
    level = orders.groupBy("series_id", cal.month_start("timestamp").alias("m")).agg((F.pmod(F.count(F.lit(1)), F.lit(4)) * 0.25).alias("value"))
    days = orders.distinct().withColumn("m", cal.month_start("timestamp"))
    return days.join(level, ["series_id", "m"]).select("series_id", "timestamp", F.col("value").cast("double").alias("value"), cal.plus_days("timestamp", 1).alias("released_at"))


cte("rates", "", """
  SELECT d.series_id, d.timestamp, CAST(l.value AS DOUBLE) AS value, d.timestamp + INTERVAL 1 DAY AS released_at
  FROM (SELECT DISTINCT o_orderpriority AS series_id, o_orderdate AS timestamp FROM orders) d
  JOIN (SELECT o_orderpriority AS series_id, date_trunc('month', o_orderdate) AS m, (count(*) % 4) * 0.25 AS value
        FROM orders GROUP BY 1, 2) l
    ON d.series_id = l.series_id AND date_trunc('month', d.timestamp) = l.m""")


def announcements(spark: SparkSession, sf: str, kind: str | None = None) -> DataFrame:
    """Irregular calendar: the last order date of each month per priority.

    Odd months are scheduled, even months unscheduled.
    """
    last = table(spark, sf, "orders").groupBy(F.col("o_orderpriority").alias("series_id"), cal.month_start("o_orderdate").alias("m")).agg(
        F.max("o_orderdate").alias("announced_at")
    )
    m = F.month("m")
    named = last.withColumn("kind", F.when(m % 2 == 1, F.lit("scheduled")).otherwise(F.lit("unscheduled"))).drop("m")
    return named if kind is None else named.filter(F.col("kind") == kind)


cte("announcements", "", """
  SELECT o_orderpriority AS series_id, max(o_orderdate) AS announced_at, CASE WHEN month(o_orderdate) % 2 = 1 THEN 'scheduled' ELSE 'unscheduled' END AS kind
  FROM orders GROUP BY 1, date_trunc('month', o_orderdate), 3""")

DIRECTIONS = (("down", -1.0), ("same", 0.0), ("up", 1.0))


def category_column() -> Column:
    return F.array(*[F.struct(F.lit(label).alias("label"), F.lit(v).alias("value")) for label, v in DIRECTIONS])


def decisions(spark: SparkSession, sf: str) -> DataFrame:
    """-1 / 0 / +1 at every announcement, stored as a series of its own because several branches read it."""
    return settled(ev.decision_outcomes(announcements(spark, sf), step_rates(spark, sf)), "decisions")


cte("decisions", "announcements rates", """
  SELECT series_id, announced_at AS timestamp,
         CASE WHEN a < b THEN -1.0::DOUBLE WHEN a > b THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS value, announced_at AS released_at
  FROM (
    SELECT n.series_id, n.announced_at,
           arg_max(r.value, r.timestamp) FILTER (WHERE r.timestamp < n.announced_at) AS b,
           arg_min(r.value, r.timestamp) FILTER (WHERE r.timestamp > n.announced_at AND r.timestamp <= n.announced_at + INTERVAL 7 DAY) AS a
    FROM announcements n JOIN rates r ON n.series_id = r.series_id
    GROUP BY 1, 2) WHERE a IS NOT NULL AND b IS NOT NULL""")


def monthly_origins(spark: SparkSession, sf: str) -> DataFrame:
    """First of every month, for every series of the observations."""
    ids = table(spark, sf, "orders").select(F.col("o_orderpriority").alias("series_id")).distinct()
    grid = cal.calendar_grid(cal.ntz("1995-03-01"), cal.ntz("2001-06-01"), "MS")
    return ids.withColumn("as_of", F.explode(grid))


cte("monthly_origins", "", """
  SELECT series_id, as_of FROM (SELECT DISTINCT o_orderpriority AS series_id FROM orders),
  (SELECT unnest(generate_series(TIMESTAMP '1995-03-01', TIMESTAMP '2001-06-01', INTERVAL 1 MONTH)) AS as_of)""")


# --- a backtest ------------------------------------------------------------------------

HORIZONS = (5, 10, 21)
START, END, STRIDE, WARMUP = "1996-01-01", "2001-06-30", 7, 30


def tasks(ids: DataFrame, *, horizons=HORIZONS, frequency="D", payload="continuous", categories: Column | None = None) -> DataFrame:
    """One task per series id."""
    cats = categories if categories is not None else F.lit(None).cast("array<struct<label:string,value:double>>")
    return ids.select("series_id").distinct().select(
        F.concat(F.lit("next_"), "series_id").alias("task_id"), F.col("series_id").alias("target_series_id"),
        F.array(*[F.lit(h) for h in horizons]).alias("horizons"), F.lit(frequency).alias("frequency"),
        F.lit(payload).alias("payload_type"), cats.alias("categories"),
    )


def specs(task_table: DataFrame, *, spec_id="weekly", start=START, end=END, stride=STRIDE, warmup=WARMUP, max_runs=None) -> DataFrame:
    return task_table.select(
        F.lit(spec_id).alias("spec_id"), "task_id", cal.ntz(start).alias("start"), cal.ntz(end).alias("end"),
        F.lit(stride).alias("stride"), F.lit(warmup).alias("warmup"), F.lit(max_runs).cast("int").alias("max_runs"),
        F.lit(None).cast("array<timestamp_ntz>").alias("origin_dates"),
    )


FORECASTERS = {"last_value_naive": fc.last_value, "log_random_walk": fc.log_random_walk}


def setup(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    ids = table(spark, sf, "orders").select(F.col("o_orderpriority").alias("series_id"))
    t = tasks(ids)
    return settled(observations(spark, sf), "observations"), t, specs(t)


def origins(spark: SparkSession, sf: str) -> DataFrame:
    _, t, s = setup(spark, sf)
    return bt.origin_table(t, s)


def scored(spark: SparkSession, sf: str) -> DataFrame:
    obs, t, s = setup(spark, sf)
    return bt.backtest(obs, t, s, FORECASTERS)


def frame(spark: SparkSession, sf: str) -> DataFrame:
    """Scored rows with errors, interval and coverage; unresolved rows kept."""
    from tidemark.operators.analysis import aligned

    obs, t, s = setup(spark, sf)
    o = bt.origin_table(t, s)
    resolved = bt.resolve(bt.forecast_all(o, obs, FORECASTERS), obs, keep_unresolved=True)
    return aligned(bt.score_predictions(resolved, t))


Z_LIST = "[" + ", ".join(repr(sc.Z_SCORES[q]) for q in sc.QUANTILE_LEVELS) + "]"

cte("series", "", "SELECT DISTINCT o_orderpriority AS series_id FROM orders")
cte("origins", "series", f"""
  SELECT 'weekly' AS spec_id, 'next_' || series_id AS task_id, series_id, as_of FROM series,
  (SELECT unnest(generate_series(TIMESTAMP '{START}', TIMESTAMP '{END}', INTERVAL {STRIDE} DAY)) AS as_of)""")
cte("path", "obs", """
  SELECT *, count(*) OVER w AS n_visible, first_value(timestamp) OVER w AS first_at, sum(r) OVER w AS r_sum, sum(r * r) OVER w AS r_squares
  FROM (SELECT *, ln(value / lag(value) OVER (PARTITION BY series_id ORDER BY timestamp)) AS r FROM obs)
  WINDOW w AS (PARTITION BY series_id ORDER BY timestamp ROWS UNBOUNDED PRECEDING)""")
cte("context", "origins path", f"""
  SELECT o.spec_id, o.task_id, o.series_id, o.as_of, p.n_visible, p.value AS last_value, p.timestamp AS last_at,
         p.r_sum / n AS mu, sqrt(greatest(0, p.r_squares - n * (p.r_sum / n) * (p.r_sum / n)) / (n - 1)) AS sd
  FROM origins o ASOF JOIN (SELECT *, date_diff('day', first_at, timestamp)::DOUBLE AS n FROM path) p
    ON o.series_id = p.series_id AND o.as_of >= p.released_at
  WHERE p.n_visible >= {WARMUP}""")
cte("predictions", "context", f"""
  SELECT spec_id, predictor_id, task_id, series_id, as_of, horizon, as_of + to_days(horizon) AS forecast_date,
         CASE predictor_id WHEN 'last_value_naive' THEN last_value ELSE exp(ln(last_value) + horizon * mu) END AS point,
         list_transform({Z_LIST}, lambda z: CASE predictor_id WHEN 'last_value_naive' THEN last_value
              ELSE exp(ln(last_value) + horizon * mu + z * sd * sqrt(horizon)) END) AS q
  FROM context, (SELECT unnest([5, 10, 21]) AS horizon), (SELECT unnest(['last_value_naive', 'log_random_walk']) AS predictor_id)""")
cte("frame", "predictions obs", """
  SELECT p.*, o.value AS actual, abs(point - o.value) AS abs_error, point - o.value AS error, q[2] AS lo80, q[10] AS hi80,
         q[10] - q[2] AS width80, CASE WHEN o.value BETWEEN q[2] AND q[10] THEN 1.0::DOUBLE WHEN o.value IS NOT NULL THEN 0.0::DOUBLE END AS inside80,
         CASE WHEN o.value <> 0 THEN abs(point - o.value) / abs(o.value) * 100 END AS ape,
         list_sum(list_transform(q, lambda x: abs(x - o.value))) / 11
           - list_sum(list_transform(q, lambda x, i: (2.0 * i - 1 - 11) * x)) / 121 AS score,
         CASE WHEN contains(predictor_id, 'naive') THEN 'Baseline' ELSE 'Other' END AS family
  FROM predictions p LEFT JOIN obs o ON p.series_id = o.series_id AND p.forecast_date = o.timestamp""")
cte("scored", "frame", "SELECT * FROM frame WHERE actual IS NOT NULL")

# --- sessions -----------------------------------------------------------------------------

SHOCK = 75.0
HOLDOUT = ("2000-01-01", "2001-06-30")


def days(spark: SparkSession, sf: str) -> DataFrame:
    return ev.sessions(prices(spark, sf))


cte("days", "prices", """
  SELECT *, CASE WHEN count(return_pct) OVER v = 21 THEN stddev_samp(return_pct) OVER v END AS vol,
         CASE WHEN count(return_pct) OVER b = 21 THEN stddev_samp(return_pct) OVER b END AS vol_before,
         coalesce(abs(return_pct) >= 75.0, false) AS shock
  FROM (SELECT series_id, timestamp, value, row_number() OVER s AS idx, (value / lag(value) OVER s - 1) * 100 AS return_pct
        FROM prices WINDOW s AS (PARTITION BY series_id ORDER BY timestamp))
  WINDOW v AS (PARTITION BY series_id ORDER BY timestamp ROWS BETWEEN 20 PRECEDING AND CURRENT ROW),
         b AS (PARTITION BY series_id ORDER BY timestamp ROWS BETWEEN 21 PRECEDING AND 1 PRECEDING)""")
cte("shocks", "days", """
  SELECT e.series_id, d.timestamp AS as_of, e.event_date, e.return_pct, e.first_idx - 1 AS as_of_idx, e.event_idx,
         CASE WHEN e.return_pct > 0 THEN 'up' ELSE 'down' END AS direction
  FROM (SELECT series_id, run, min(idx) AS first_idx, arg_max(timestamp, (abs(return_pct), -idx)) AS event_date,
               arg_max(return_pct, (abs(return_pct), -idx)) AS return_pct, arg_max(idx, (abs(return_pct), -idx)) AS event_idx
        FROM (SELECT *, sum(CASE WHEN prev IS NULL OR idx - prev > 1 THEN 1 ELSE 0 END) OVER (PARTITION BY series_id ORDER BY idx) AS run
              FROM (SELECT *, lag(idx) OVER (PARTITION BY series_id ORDER BY idx) AS prev FROM days WHERE shock))
        GROUP BY 1, 2) e
  JOIN days d ON d.series_id = e.series_id AND d.idx = e.first_idx - 1""")
