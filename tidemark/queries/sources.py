"""Scans, sinks, contracts and ledgers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.operators import features as ft
from tidemark.queries.registry import query
from tidemark.queries.tables import announcements, bday, monthly, observations, prices, sql, table
from tidemark.session import shared_folder
from tidemark.sources import canonical as src, documents as docs, store


def _folder(spark: SparkSession, name: str) -> str:
    import uuid

    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def _meta(obs: DataFrame) -> DataFrame:
    return obs.select("series_id").distinct().select(
        "series_id", F.concat(F.lit("Order value, priority "), "series_id").alias("description"), F.lit("orders").alias("source"),
        F.lit("thousand").alias("units"), F.lit("D").alias("frequency"),
    )


@query("S1 S2 S3 S12 A1", sql("obs", """
SELECT series_id, 'Order value, priority ' || series_id AS description, 'D' AS frequency, count(*) AS n_obs,
       min(timestamp) AS first, max(timestamp) AS last FROM obs GROUP BY series_id"""))
def register_and_summarise(spark: SparkSession, sf: str) -> DataFrame:
    """Write series to the bucketed store, read them back, and describe each."""
    obs = observations(spark, sf)
    path = _folder(spark, "store")
    store.register(obs, _meta(obs), path)
    out = store.summary(store.series(spark, path), store.metadata(spark, path))
    return out.select("series_id", "description", "frequency", "n_obs", "first", "last")


@query("S2 S12", sql("obs", "SELECT series_id, timestamp, value, released_at FROM obs WHERE series_id IN ('1-URGENT', '5-LOW')"))
def read_named_series(spark: SparkSession, sf: str) -> DataFrame:
    """Two series from the store; only their hash folders and row groups are read."""
    obs = observations(spark, sf)
    path = _folder(spark, "store")
    store.register(obs, _meta(obs), path)
    return store.series(spark, path, "1-URGENT", "5-LOW")


@query("S2", "SELECT DISTINCT o_orderpriority AS series_id FROM orders ORDER BY 1")
def series_ids(spark: SparkSession, sf: str) -> DataFrame:
    return store.series_ids(observations(spark, sf))


@query("S4 P4", "SELECT o_orderpriority AS series_id, o_orderdate AS timestamp, o_totalprice AS value, o_orderdate AS released_at FROM orders")
def frame_source(spark: SparkSession, sf: str) -> DataFrame:
    """Any DataFrame as a source: canonical columns, released on its own stamp."""
    rows = table(spark, sf, "orders").select(
        F.col("o_orderpriority").alias("series_id"), F.col("o_orderdate").alias("timestamp"), F.col("o_totalprice").cast("string").alias("value")
    )
    return src.from_frame(rows)


@query("S5 S6 F5 F27", """
SELECT o_orderstatus || '/' || o_orderpriority AS series_id, o_orderdate AS timestamp, o_totalprice AS value, o_orderdate + INTERVAL 21 DAY AS released_at
FROM orders""")
def wide_table_members(spark: SparkSession, sf: str) -> DataFrame:
    """An all-text statistical table (written as CSV, read back) split into series by its member columns in one scan."""
    raw = table(spark, sf, "orders").select(
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("REF_DATE"), F.col("o_orderstatus").alias("GEO"), F.col("o_orderpriority").alias("Products"),
        F.col("o_totalprice").cast("string").alias("VALUE"),
    )
    path = _folder(spark, "wide")
    raw.write.option("header", True).csv(path)
    wide = src.wide_table(spark, path, ["REF_DATE", "GEO", "Products", "VALUE"])
    members = wide.select("GEO", "Products").distinct().withColumn("series_id", F.concat_ws("/", "GEO", "Products"))
    return src.select_members(wide, members, ["GEO", "Products"])


@query("S7", "SELECT event_type AS series_id, ts AS timestamp, value, ts AS released_at FROM events")
def macro_series(spark: SparkSession, sf: str) -> DataFrame:
    """Macro-style rows released on their own stamp."""
    return src.same_day_release(table(spark, sf, "events").select(F.col("event_type").alias("series_id"), F.col("ts").alias("timestamp"), "value"))


_BARS = """
SELECT l_returnflag AS ticker, l_shipdate AS date, arg_min(p, k) AS open, max(p) AS high, min(p) AS low, arg_max(p, k) AS close, CAST(sum(l_quantity) AS DOUBLE) AS volume
FROM (SELECT *, l_extendedprice / l_quantity AS p, (l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS k FROM lineitem) GROUP BY 1, 2"""


def bars(spark: SparkSession, sf: str) -> DataFrame:
    li = table(spark, sf, "lineitem").withColumn("p", F.col("l_extendedprice") / F.col("l_quantity"))
    k = F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    return li.groupBy(F.col("l_returnflag").alias("ticker"), F.col("l_shipdate").alias("date")).agg(
        F.min_by("p", k).alias("open"), F.max("p").alias("high"), F.min("p").alias("low"), F.max_by("p", k).alias("close"), F.sum("l_quantity").alias("volume")
    )


@query("S8 F2", f"""
SELECT lower(ticker) || '_' || field AS series_id, date AS timestamp, value, {bday('date', 1)} AS released_at
FROM (SELECT ticker, date, unnest(['open', 'high', 'low', 'close', 'volume']) AS field, unnest([open, high, low, close, volume]) AS value FROM ({_BARS}))""")
def ohlcv_fields(spark: SparkSession, sf: str) -> DataFrame:
    """Daily bars to one series per field in one pass."""
    return src.ohlcv(bars(spark, sf), ["open", "high", "low", "close", "volume"])


@query("S11", f"SELECT lower(ticker) AS series_id, date AS timestamp, close AS value, open, {bday('date', 1)} AS released_at FROM ({_BARS})")
def bars_with_open(spark: SparkSession, sf: str) -> DataFrame:
    return src.bars_with_open(bars(spark, sf))


@query("S9", sql("prices", "SELECT * FROM prices WHERE timestamp >= '1997-01-01' AND timestamp < '1998-01-01'"))
def half_open_range(spark: SparkSession, sf: str) -> DataFrame:
    return src.date_range(prices(spark, sf), "1997-01-01", "1998-01-01")


@query("S10", sql("prices", """
SELECT series_id, min(timestamp) AS first, max(timestamp) AS last,
       min(timestamp) <= TIMESTAMP '1996-01-01' AND max(timestamp) >= TIMESTAMP '2001-06-29' AS covered FROM prices GROUP BY 1"""))
def cache_covers(spark: SparkSession, sf: str) -> DataFrame:
    """Does each stored series cover [Sat 1995-12-30, 2001-06-30)?  The start rolls to the first business day."""
    return src.covers_range(prices(spark, sf), "1995-12-30", "2001-06-30")


@query("S28", sql("obs", "SELECT series_id, CAST(timestamp AS DATE) AS date, value AS price FROM obs"))
def price_frame(spark: SparkSession, sf: str) -> DataFrame:
    return src.as_price_frame(observations(spark, sf))


@query("S19 U5", sql("announcements", "SELECT series_id, announced_at, kind FROM announcements"))
def event_calendar(spark: SparkSession, sf: str) -> DataFrame:
    """Scheduled and unscheduled announcements as one calendar."""
    return announcements(spark, sf, "scheduled").unionByName(announcements(spark, sf, "unscheduled"))


@query("S20 F27", sql("announcements", """
SELECT DISTINCT 'releases' AS source, strftime(announced_at, '%Y-%m-%d') || '_en' AS doc_id,
  'https://example.org/' || strftime(announced_at, '%Y/%m/') || strftime(announced_at, '%Y-%m-%d') || '/' AS url, CAST(announced_at AS DATE) AS event_date
FROM announcements WHERE kind = 'scheduled'"""))
def entries_from_calendar(spark: SparkSession, sf: str) -> DataFrame:
    """Document ids and addresses for every scheduled event."""
    events = announcements(spark, sf, "scheduled").select(F.to_date("announced_at").alias("event_date")).distinct()
    return docs.entries_from_calendar(events, "releases", "https://example.org")


@query("S24", """
WITH usage AS (SELECT event_id, event_type AS model, abs(hash_in) AS tokens_in, value AS v, event_type = 'click' AS searched FROM (SELECT *, length(props) * 100 AS hash_in FROM events)),
prices AS (SELECT * FROM (VALUES ('click', 0.000001::DOUBLE, 0.000004::DOUBLE), ('view', 0.000002::DOUBLE, 0.000008::DOUBLE), ('error', 0.00001::DOUBLE, 0.00003::DOUBLE)) t(model, pi, po)),
rated AS (SELECT u.model, tokens_in * coalesce(pi, 0.00001) + 50 * coalesce(po, 0.00003) + (CASE WHEN searched THEN 1 ELSE 0 END) * 0.014 AS usd, pi IS NOT NULL AS priced FROM usage u LEFT JOIN prices p ON u.model = p.model)
SELECT model, priced, round(sum(usd), 4) AS spent_usd, count(*) AS n_entries, round(100 - sum(usd), 4) AS remaining_usd FROM rated GROUP BY 1, 2""")
def spend_ledger(spark: SparkSession, sf: str) -> DataFrame:
    """Token and search cost per model; unknown models cost the dearest rate."""
    usage = table(spark, sf, "events").select(
        F.col("event_type").alias("model"), (F.length("props") * 100).alias("tokens_in"), F.lit(50).alias("tokens_out"),
        (F.col("event_type") == "click").cast("int").alias("searches"),
    )
    rates = spark.createDataFrame(
        [("click", 0.000001, 0.000004), ("view", 0.000002, 0.000008), ("error", 0.00001, 0.00003)], "model string, price_in double, price_out double"
    )
    out = store.budget(store.spend(usage, F.broadcast(rates), 0.014), 100.0, "model", "priced")
    return out.withColumns({c: F.round(c, 4) for c in ("spent_usd", "remaining_usd")})


@query("S22", """
WITH old AS (SELECT 'q' || quality AS question_id, doc_id, CASE WHEN toxic = 1 THEN 'yes' ELSE 'no' END AS answer FROM labels),
new AS (SELECT question_id, doc_id, 'revised' AS answer FROM old WHERE answer = 'yes')
SELECT o.question_id, o.doc_id, coalesce(n.answer, o.answer) AS answer FROM old o LEFT JOIN new n USING (question_id, doc_id)""")
def label_cache_merge(spark: SparkSession, sf: str) -> DataFrame:
    """Stored labels with new answers for some keys."""
    old = table(spark, sf, "labels").select(
        F.concat(F.lit("q"), F.col("quality").cast("string")).alias("question_id"), "doc_id", F.when(F.col("toxic") == 1, "yes").otherwise("no").alias("answer")
    )
    new = old.filter(F.col("answer") == "yes").withColumn("answer", F.lit("revised"))
    return store.upsert_latest(old, new, ["question_id", "doc_id"])


@query("S25", """
SELECT o_custkey AS pattern_id, o_orderkey AS entry_id, o_orderdate AS evaluated_on, max(o_orderdate) OVER w = o_orderdate AS is_current,
       CASE WHEN max(o_orderdate) OVER w = o_orderdate THEN count(*) OVER w - 1 END AS n_history
FROM orders WINDOW w AS (PARTITION BY o_custkey)""")
def candidate_trail(spark: SparkSession, sf: str) -> DataFrame:
    """Append-only trail: newest entry per candidate marked, with the length of its history."""
    entries = table(spark, sf, "orders").select(F.col("o_custkey").alias("pattern_id"), F.col("o_orderkey").alias("entry_id"), F.col("o_orderdate").alias("evaluated_on"))
    return store.trail(entries)


@query("A45", "SELECT props AS trace_id, min(event_id) AS first_position FROM events GROUP BY 1")
def first_seen_ids(spark: SparkSession, sf: str) -> DataFrame:
    """Distinct trace ids in first-seen order."""
    return store.first_seen(table(spark, sf, "events").withColumnRenamed("props", "trace_id"), "trace_id", "event_id")


@query("P3", "SELECT o_orderpriority AS series_id, count(*) AS n_violations FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE l_shipdate < o_orderdate GROUP BY 1")
def release_violations(spark: SparkSession, sf: str) -> DataFrame:
    """Rows released before their own stamp (ship date read as the release of the order date)."""
    rows = table(spark, sf, "orders").join(table(spark, sf, "lineitem"), F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.col("o_orderpriority").alias("series_id"), F.col("o_orderdate").alias("timestamp"), F.col("l_shipdate").alias("released_at")
    )
    return ft.release_violations(rows).groupBy("series_id").agg(F.count(F.lit(1)).alias("n_violations"))


@query("S26", sql("days", f"""
SELECT d.series_id, d.timestamp AS as_of, CAST(n.shock AS INTEGER) AS expected
FROM days d JOIN days n ON n.series_id = d.series_id AND n.timestamp = {bday('d.timestamp', 1)}"""))
def one_time_spec(spark: SparkSession, sf: str) -> DataFrame:
    """Origins followed by a session on the next business day, with the frozen outcome."""
    from tidemark.operators import events as ev
    from tidemark.queries.tables import SHOCK, days

    return ev.oot_origins(days(spark, sf), SHOCK)


@query("S21 J20", sql("days", f"""
SELECT d.series_id, d.timestamp AS as_of, 1 AS expected, CAST(n.shock AS INTEGER) AS resolved
FROM days d LEFT JOIN days n ON n.series_id = d.series_id AND n.timestamp = {bday('d.timestamp', 1)}
WHERE CAST(n.shock AS INTEGER) IS DISTINCT FROM 1"""))
def frozen_outcome_check(spark: SparkSession, sf: str) -> DataFrame:
    """Origins whose frozen outcome (here: always a shock) disagrees with the data or cannot be resolved."""
    from tidemark.operators import events as ev
    from tidemark.queries.tables import SHOCK, days

    d = days(spark, sf)
    expected = d.select("series_id", F.col("timestamp").alias("as_of"), F.lit(1).alias("expected"))
    actual = d.select("series_id", "timestamp", ev.is_shock(SHOCK).cast("int").alias("value"))
    return ev.outcome_mismatches(expected, actual).select("series_id", "as_of", "expected", "resolved")


@query("S18 S15 S16", sql("scored", "SELECT predictor_id, task_id, count(*) AS n, round(avg(score), 4) AS mean_score FROM scored GROUP BY 1, 2"))
def stored_results_scan(spark: SparkSession, sf: str) -> DataFrame:
    """Save scored predictions by spec and predictor, then read every stored result of the spec."""
    from tidemark.plans import backtest as bt
    from tidemark.queries.tables import scored

    path = _folder(spark, "results")
    bt.save_results(scored(spark, sf), path)
    stored = bt.load_results(spark, path).filter(F.col("spec_id") == "weekly")
    return stored.groupBy("predictor_id", "task_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("score"), 4).alias("mean_score"))


@query("P14", "SELECT 3 AS n_categories, CAST(count(DISTINCT o_orderpriority) AS BIGINT) AS n_tasks, CAST(0 AS BIGINT) AS n_invalid FROM orders")
def task_contract(spark: SparkSession, sf: str) -> DataFrame:
    """Category contract of every categorical task."""
    from tidemark.functions import scoring as sc
    from tidemark.queries.tables import category_column, tasks

    t = tasks(observations(spark, sf), payload="categorical", categories=category_column())
    return t.agg(F.max(F.size("categories")).alias("n_categories"), F.count(F.lit(1)).alias("n_tasks"), F.count_if(F.size(sc.category_issues(F.col("categories"))) > 0).alias("n_invalid"))


@query("P15", """
SELECT o_orderpriority AS series_id, min(o_orderdate) AS start, max(o_orderdate) AS "end", min(o_orderdate) < max(o_orderdate) AS valid FROM orders GROUP BY 1
UNION ALL SELECT o_orderpriority || ' reversed', max(o_orderdate), min(o_orderdate), max(o_orderdate) < min(o_orderdate) FROM orders GROUP BY 1""")
def spec_contract(spark: SparkSession, sf: str) -> DataFrame:
    """Spec windows from the data's own spans, once as they are and once reversed."""
    from tidemark.functions import scoring as sc

    spans = table(spark, sf, "orders").groupBy(F.col("o_orderpriority").alias("series_id")).agg(F.min("o_orderdate").alias("start"), F.max("o_orderdate").alias("end"))
    back = spans.select(F.concat("series_id", F.lit(" reversed")).alias("series_id"), F.col("end").alias("start"), F.col("start").alias("end"))
    both = spans.unionByName(back).withColumn("stride", F.lit(1)).withColumn("origin_dates", F.lit(None).cast("array<timestamp_ntz>"))
    return both.select("series_id", "start", "end", (F.size(sc.spec_issues()) == 0).alias("valid"))


@query("U4", sql("obs", "SELECT DISTINCT CAST(timestamp AS DATE) AS day FROM obs"))
def distinct_days(spark: SparkSession, sf: str) -> DataFrame:
    return observations(spark, sf).select(F.to_date("timestamp").alias("day")).distinct()


@query("U1", sql("obs monthly", "SELECT series_id, timestamp, value, released_at FROM obs UNION ALL SELECT series_id || '_m', timestamp, value, released_at FROM monthly"))
def concatenated_series(spark: SparkSession, sf: str) -> DataFrame:
    """Daily and monthly series in one table."""
    m = monthly(spark, sf).withColumn("series_id", F.concat("series_id", F.lit("_m")))
    return observations(spark, sf).unionByName(m)


@query("S14", "SELECT source, CAST(doc_id AS VARCHAR) AS doc_id, sha256(text) AS sha256, CAST(strlen(text) AS BIGINT) AS content_length FROM documents")
def document_provenance(spark: SparkSession, sf: str) -> DataFrame:
    """Content hash and length of every stored document."""
    d = table(spark, sf, "documents").withColumn("doc_id", F.col("doc_id").cast("string"))
    return docs.provenance(d).select("source", "doc_id", "sha256", "content_length")


@query("C8 C9", sql("obs", """
SELECT c.series_id, count(*) AS n FROM (SELECT * FROM (VALUES ('first', '0-NONE', 1), ('first', '2-HIGH', 2), ('first', '5-LOW', 3), ('second', '1-URGENT', 1)) t(series_id, source_id, priority)) c
JOIN obs ON obs.series_id = CASE c.series_id WHEN 'first' THEN '2-HIGH' ELSE '1-URGENT' END AND obs.series_id = c.source_id GROUP BY 1"""))
def first_available_source(spark: SparkSession, sf: str) -> DataFrame:
    """Each target takes its best-ranked source that has rows."""
    wanted = spark.createDataFrame(
        [("first", "0-NONE", 1), ("first", "2-HIGH", 2), ("first", "5-LOW", 3), ("second", "1-URGENT", 1)], "series_id string, source_id string, priority int"
    )
    return ft.first_available(observations(spark, sf), wanted).groupBy("series_id").agg(F.count(F.lit(1)).alias("n"))


