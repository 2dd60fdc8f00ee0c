"""Dated documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tidemark.functions import calendar as cal, text as tx
from tidemark.operators import asof
from tidemark.plans import study
from tidemark.queries.forecasts import decision_forecasts
from tidemark.queries.registry import query
from tidemark.queries.sources import _folder
from tidemark.queries.tables import announcements, category_column, decisions, observations, prices, rounded, sql, table
from tidemark.session import spread
from tidemark.sources import documents as docs


def documents(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select(
        "source", F.col("doc_id").cast("string").alias("doc_id"), F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id") % 365).cast("int")).alias("publication_date"),
        F.lit(None).cast("string").alias("title"), "lang", "text", F.lit(1).alias("page_count"), "n_chars",
    )


_DOCS = "docs AS (SELECT source, CAST(doc_id AS VARCHAR) AS doc_id, DATE '2024-01-01' + CAST(doc_id % 365 AS INTEGER) AS publication_date, lang, text, n_chars FROM documents)"


@query("J22", f"WITH {_DOCS} SELECT source, doc_id, publication_date FROM docs WHERE publication_date <= DATE '2024-06-30'")
def documents_visible(spark: SparkSession, sf: str) -> DataFrame:
    return docs.visible(documents(spark, sf), as_of="2024-06-30").select("source", "doc_id", "publication_date")


@query("J22", f"""WITH {_DOCS}, o AS (SELECT s.source, g.as_of FROM (SELECT DISTINCT source FROM docs) s, (SELECT unnest(generate_series(TIMESTAMP '2024-01-15', TIMESTAMP '2024-12-15', INTERVAL 1 MONTH)) AS as_of) g)
SELECT o.source, o.as_of, count(d.doc_id) AS n_documents, max((d.publication_date, d.doc_id))[2] AS newest_doc FROM o LEFT JOIN docs d ON d.source = o.source AND d.publication_date <= o.as_of GROUP BY 1, 2""".replace(
    "max((d.publication_date, d.doc_id))[2]", "arg_max(d.doc_id, (d.publication_date, d.doc_id))"))
def documents_at_origins(spark: SparkSession, sf: str) -> DataFrame:
    """How many documents each source had published at each origin, and the newest."""
    d = documents(spark, sf)
    grid = F.expr("sequence(timestamp_ntz'2024-01-15', timestamp_ntz'2024-12-15', interval 1 month)")
    o = d.select("source").distinct().withColumn("as_of", F.explode(grid))
    return docs.visible(d, o).select("source", "as_of", "n_documents", F.col("newest.doc_id").alias("newest_doc"))


@query("J22", f"WITH {_DOCS} SELECT d.source, d.doc_id, CAST(o.o AS DATE) AS event_date FROM (SELECT DISTINCT publication_date AS o FROM docs) o JOIN docs d ON d.publication_date = o.o")
def document_for_date(spark: SparkSession, sf: str) -> DataFrame:
    """The documents published on each event date."""
    d = documents(spark, sf)
    events = d.select("source", F.col("publication_date").alias("event_date")).distinct()
    return docs.for_date(d, events).select("source", "doc_id", "event_date")


@query("T5", f"WITH {_DOCS} SELECT source, arg_min(doc_id, (publication_date, doc_id)) AS first_doc, arg_max(doc_id, (publication_date, doc_id)) AS last_doc, count(*) AS n_documents FROM docs GROUP BY 1")
def first_and_last_document(spark: SparkSession, sf: str) -> DataFrame:
    return docs.first_and_last(documents(spark, sf))


@query("F17 F22", "SELECT CAST(doc_id AS VARCHAR) AS doc_id, CAST((length(text) + 3) // 4 AS BIGINT) AS est_tokens FROM documents WHERE n_chars >= 400")
def token_estimates(spark: SparkSession, sf: str) -> DataFrame:
    """Token estimates of the documents long enough for their page count."""
    return docs.enough_text(documents(spark, sf), 400).select("doc_id", tx.estimated_tokens(F.length("text")).alias("est_tokens"))


@query("F18", f"""WITH {_DOCS}
SELECT doc_id, sha256('=== ' || source || '/' || doc_id || ' ===' || chr(10) || 'Source: ' || source || chr(10) || 'Published: ' || strftime(publication_date, '%Y-%m-%d') || chr(10) || chr(10)
  || CASE WHEN length(text) > 500 THEN substr(text, 1, 500) || chr(10) || chr(10) || '[...]' ELSE text END) AS block_hash FROM docs""")
def document_blocks(spark: SparkSession, sf: str) -> DataFrame:
    """Titled, dated blocks, texts cut at 500 characters with a marker (the cut is the feature)."""
    return documents(spark, sf).select("doc_id", F.sha2(tx.document_block(500), 256).alias("block_hash"))


@query("F19 W11", sql("monthly_origins prices", """
, v AS (SELECT p.series_id, m.as_of, p.timestamp, p.value, row_number() OVER (PARTITION BY p.series_id, m.as_of ORDER BY p.timestamp DESC) AS r
  FROM (SELECT DISTINCT as_of FROM monthly_origins) m JOIN prices p ON p.released_at <= m.as_of)
SELECT series_id, as_of, string_agg(strftime(timestamp, '%Y-%m-%d') || ': ' || printf('%.2f', value), chr(10) ORDER BY timestamp) AS history FROM v WHERE r <= 12 GROUP BY 1, 2"""))
def history_text(spark: SparkSession, sf: str) -> DataFrame:
    """The 12 latest visible values of each origin as text lines."""
    p = prices(spark, sf)
    grid = cal.calendar_grid(cal.ntz("1995-03-01"), cal.ntz("2001-06-01"), "MS")
    o = p.select("series_id").distinct().withColumn("as_of", F.explode(grid))
    rows = asof.trailing_visible(o, p, 12)
    return tx.history_text(rows, ["series_id", "as_of"], tx.fixed_text("value", F.lit(2))).select("series_id", "as_of", "history")


@query("F19 P17", sql("decisions", """
SELECT series_id, string_agg(strftime(timestamp, '%Y-%m-%d') || ': ' || CASE value WHEN -1 THEN 'down' WHEN 0 THEN 'same' ELSE 'up' END, chr(10) ORDER BY timestamp) AS history, CAST(count(*) AS INTEGER) AS n_lines FROM decisions GROUP BY 1"""))
def category_history_text(spark: SparkSession, sf: str) -> DataFrame:
    """Decisions as dated labels."""
    from tidemark.functions import scoring as sc

    return tx.history_text(decisions(spark, sf), ["series_id"], sc.category_label(category_column(), F.col("value")))


@query("F20", sql("obs", """
, c AS (SELECT series_id, max(timestamp) - INTERVAL 6 MONTH AS start FROM obs GROUP BY 1)
SELECT o.series_id, CAST(timestamp AS DATE) AS day, round(value, 7) AS value, 'daily' AS grain FROM obs o JOIN c USING (series_id) WHERE timestamp >= start
UNION ALL SELECT o.series_id, CAST(timestamp + to_days(CAST(7 - isodow(timestamp) AS INTEGER)) AS DATE), round(avg(value), 7), 'weekly' FROM obs o JOIN c USING (series_id) WHERE timestamp < start GROUP BY 1, 2"""))
def compressed_history(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(tx.compressed_history(observations(spark, sf)), 7, "value")


@query("F20", sql("obs", """
, c AS (SELECT series_id, max(timestamp) - INTERVAL 6 MONTH AS start FROM obs GROUP BY 1)
SELECT o.series_id, CAST(timestamp AS DATE) AS day, round(value, 7) AS value, 'daily' AS grain FROM obs o JOIN c USING (series_id) WHERE timestamp >= start
UNION ALL SELECT o.series_id, CAST(timestamp + to_days(CAST(7 - isodow(timestamp) AS INTEGER)) AS DATE), round(avg(value), 7), 'weekly' FROM obs o JOIN c USING (series_id) WHERE timestamp < start AND timestamp >= start - INTERVAL 2 YEAR GROUP BY 1, 2"""))
def compressed_history_two_years(spark: SparkSession, sf: str) -> DataFrame:
    """The same with weekly means for the two years before the daily part only."""
    return rounded(tx.compressed_history(observations(spark, sf), weekly_years=2), 7, "value")


# --- text ---------------------------------------------------------------------------------------------------


# Blanks and line breaks as Python's strings know them; named characters are read with or without their semicolon, as in HTML.
_BLANK = r"[\s\x0B\x1C-\x1F\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"
_NAMED = {"quot": '"', "copy": "©", "middot": "·", "lt": "<", "gt": ">", "amp": "&"}  # the ampersand last: what it starts is no name
_UNNAMED = "regexp_replace(h, '<[^>]*>', chr(10), 'g')"
for _name, _char in _NAMED.items():
    _UNNAMED = f"regexp_replace({_UNNAMED}, '&{_name};?', '{_char}', 'g')"

_PAGE_SQL = rf"""
WITH a AS (SELECT page_id, regexp_extract(regexp_replace(html, '(?s)<!--.*?-->', '', 'g'), '(?is)<article[^>]*>(.*?)</article>', 1) AS h FROM pages),
t AS (SELECT page_id, {_UNNAMED} AS t FROM a),
l AS (SELECT page_id, list_filter(list_transform(string_split_regex(t, '[\n\x0B\f\r\x1C\x1D\x1E\x{{85}}\x{{2028}}\x{{2029}}]'), lambda x: regexp_replace(x, '^{_BLANK}|{_BLANK}$', '', 'g')), lambda x: x <> '' AND NOT starts_with(lower(x), 'share this page')) AS l FROM t),
j AS (SELECT page_id, regexp_replace(regexp_replace(chr(10) || array_to_string(l, chr(10)), '(?s)\n(Footnotes|Content Type\(s\)).*$', ''), '^\n', '') AS text FROM l)
SELECT page_id, length(text) AS n_chars, CAST((length(text) + 3) // 4 AS BIGINT) AS est_tokens, length(text) >= 400 AS usable, sha256(text) AS text_hash FROM j"""


@query("F21 F22", _PAGE_SQL)
def page_text(spark: SparkSession, sf: str) -> DataFrame:
    """Readable text of every page; short ones flagged."""
    p = docs.from_pages(spread(table(spark, sf, "pages")), "pages", 400)
    return p.select("page_id", "n_chars", "est_tokens", "usable", F.sha2("text", 256).alias("text_hash"))


def _dated_text() -> Column:
    """Whole document texts with dated sentences woven in, so the fence has work on every row."""
    day = F.date_format("publication_date", "d")
    return F.concat(
        F.lit("- The U.S. Dept. on "), F.date_format("publication_date", "MMM"), F.lit(". "), day, F.lit(", 2024 set rules. Shares fell on 27 January 2023. In "),
        F.date_format("publication_date", "MMMM yyyy"), F.lit(" demand rose.\n"), F.col("text"), F.lit("\nIssued "), F.date_format("publication_date", "yyyy-MM-dd"), F.lit("."),
    )


_MONTHS = r"(?:September|February|November|December|January|October|August|March|April|Sept|June|July|Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)"
_NUM = "CASE substr(regexp_extract(x, '[A-Z][a-z]+'), 1, 3) " + " ".join(
    f"WHEN '{m}' THEN {i}" for i, m in enumerate("Jan Feb Mar Apr May Jun Jul Aug Sep Oct Nov Dec".split(), 1)) + " END"
_YEAR = "CAST(right(x, 4) AS INTEGER)"
_FENCE_SQL = rf"""
WITH {_DOCS},
t AS (SELECT doc_id, '- The U.S. Dept. on ' || strftime(publication_date, '%b') || '. ' || day(publication_date) || ', 2024 set rules. Shares fell on 27 January 2023. In ' || strftime(publication_date, '%B %Y')
    || ' demand rose.' || chr(10) || text || chr(10) || 'Issued ' || strftime(publication_date, '%Y-%m-%d') || '.' AS text, DATE '2024-06-15' AS cutoff FROM docs),
l AS (SELECT doc_id, cutoff, unnest(string_split_regex(regexp_replace(text, '(?:\r\n|[\n\x0B\f\r\x1C\x1D\x1E\x85\x{{2028}}\x{{2029}}])$', ''), '\r\n|[\n\x0B\f\r\x1C\x1D\x1E\x{{85}}\x{{2028}}\x{{2029}}]')) AS line,
      unnest(range(1, len(string_split_regex(regexp_replace(text, '(?:\r\n|[\n\x0B\f\r\x1C\x1D\x1E\x85\x{{2028}}\x{{2029}}])$', ''), '\r\n|[\n\x0B\f\r\x1C\x1D\x1E\x{{85}}\x{{2028}}\x{{2029}}]')) + 1)) AS i FROM t),
p AS (SELECT *, regexp_extract(line, '^(\s*(?:[-*+]\s+|\d+[.)]\s+|#+\s+|>\s+)?)', 1) AS prefix FROM l),
s AS (SELECT *, string_split(regexp_replace(regexp_replace(trim(substr(line, length(prefix) + 1)), '((?:\b[A-Z]|\b(?:Inc|Corp|Co|Ltd|Jr|Sr|Mr|Mrs|Ms|Dr|St|Dept|Gov|Sen|Rep|vs|No|approx|est|{_MONTHS}))\.)\s+', '\1' || chr(1), 'g'), '([.!?])\s+', '\1' || chr(2), 'g'), chr(2)) AS parts FROM p),
x AS (SELECT doc_id, i, cutoff, trim(line) = '' AS blank, line, prefix, list_transform(parts, lambda q: replace(q, chr(1), ' ')) AS parts FROM s),
k AS (SELECT doc_id, i, blank, line, prefix, list_transform(parts, lambda q: struct_pack(q := q, late :=
    len(list_filter(regexp_extract_all(q, '\b{_MONTHS}\.?\s+\d{{1,2}}(?:st|nd|rd|th)?,?\s+\d{{4}}\b'), lambda x: coalesce(TRY_CAST(printf('%04d-%02d-%02d', {_YEAR}, {_NUM}, CAST(regexp_extract(x, '\s(\d{{1,2}})(?:st|nd|rd|th)?,?\s+\d{{4}}$', 1) AS INTEGER)) AS DATE) >= cutoff, false))) > 0
    OR len(list_filter(regexp_extract_all(q, '\b\d{{1,2}}(?:st|nd|rd|th)?\s+(?:of\s+)?{_MONTHS}\.?,?\s+\d{{4}}\b'), lambda x: coalesce(TRY_CAST(printf('%04d-%02d-%02d', {_YEAR}, {_NUM}, CAST(regexp_extract(x, '^(\d{{1,2}})', 1) AS INTEGER)) AS DATE) >= cutoff, false))) > 0
    OR len(list_filter(regexp_extract_all(q, '\b\d{{4}}-\d{{2}}-\d{{2}}\b'), lambda x: coalesce(TRY_CAST(x AS DATE) >= cutoff, false))) > 0
    OR len(list_filter(regexp_extract_all(q, '\b{_MONTHS}\.?\s+\d{{4}}\b'), lambda x: {_YEAR} * 12 + {_NUM} >= year(cutoff) * 12 + month(cutoff))) > 0)) AS j FROM x),
o AS (SELECT doc_id, i, CASE WHEN blank THEN line WHEN len(list_filter(j, lambda y: NOT y.late)) > 0 THEN prefix || array_to_string(list_transform(list_filter(j, lambda y: NOT y.late), lambda y: y.q), ' ') END AS kept,
  CASE WHEN blank THEN 0 ELSE len(list_filter(j, lambda y: y.late)) END AS n_late FROM k)
SELECT doc_id, sha256(coalesce(string_agg(kept, chr(10) ORDER BY i), '')) AS kept_hash, CAST(sum(n_late) AS INTEGER) AS n_dropped FROM o GROUP BY 1"""


@query("F23", _FENCE_SQL)
def date_fence(spark: SparkSession, sf: str) -> DataFrame:
    """Sentences naming a date on or after the cutoff are removed from every whole text."""
    d = spread(documents(spark, sf)).withColumn("text", _dated_text())
    out = d.withColumn("_f", tx.fence(F.col("text"), F.lit("2024-06-15").cast("date")))
    return out.select("doc_id", F.sha2("_f.kept", 256).alias("kept_hash"), F.size("_f.dropped").alias("n_dropped"))


@query("F24", f"WITH {_DOCS} SELECT doc_id, CASE WHEN CAST(doc_id AS BIGINT) % 7 = 0 THEN true ELSE publication_date < DATE '2024-06-15' END AS retrospective FROM docs")
def retrospective_cutoffs(spark: SparkSession, sf: str) -> DataFrame:
    """Cutoffs before today; unparseable ones count as retrospective."""
    d = documents(spark, sf)
    text = F.when(F.col("doc_id").cast("long") % 7 == 0, F.lit("soon")).otherwise(F.date_format("publication_date", "yyyy-MM-dd"))
    return d.select("doc_id", tx.is_retrospective(text, F.lit("2024-06-15").cast("date")).alias("retrospective"))


@query("F27", "SELECT CAST(doc_id AS VARCHAR) AS doc_id, regexp_replace(regexp_replace(lower(source || ' / ' || lang || '#' || doc_id), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') AS key FROM documents")
def safe_keys(spark: SparkSession, sf: str) -> DataFrame:
    from tidemark.sources.canonical import safe_key

    d = documents(spark, sf)
    return d.select("doc_id", safe_key(F.concat("source", F.lit(" / "), "lang", F.lit("#"), "doc_id")).alias("key"))


# --- files and joins with outcomes ----------------------------------------------------------------------------


@query("S13", """
SELECT CAST(doc_id AS VARCHAR) AS doc_id, DATE '2024-01-01' + CAST(doc_id % 365 AS INTEGER) AS publication_date, lang, sha256(text) AS text_hash, CAST(length(text) AS BIGINT) AS n_chars
FROM documents WHERE doc_id % 11 <> 0""")
def artefact_scan(spark: SparkSession, sf: str) -> DataFrame:
    """JSON artefacts, some with their text in a companion, some malformed (and skipped)."""
    d = documents(spark, sf).withColumn("n", F.col("doc_id").cast("long"))
    meta = F.struct("doc_id", F.col("publication_date").cast("string").alias("publication_date"), "lang")
    body = F.to_json(F.struct(meta.alias("meta"), F.when(F.col("n") % 7 != 0, F.col("text")).otherwise(F.lit("")).alias("text"), "page_count"))
    path = _folder(spark, "artefacts")
    d.select(F.col("doc_id").alias("stem"), F.when(F.col("n") % 11 == 0, F.substring(body, 1, 25)).otherwise(body).alias("json")).write.parquet(path)
    companions = d.filter("n % 7 = 0").select(F.col("doc_id").alias("stem"), "text")
    out = docs.parse_artefacts(spark.read.parquet(path), companions, "src")
    return out.select("doc_id", "publication_date", "lang", F.sha2("text", 256).alias("text_hash"), "n_chars")


@query("S14", f"WITH {_DOCS} SELECT doc_id, publication_date, lang, sha256(text) AS text_hash FROM docs")
def artefacts_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """Documents written as a partitioned table with hashes and read back."""
    path = _folder(spark, "documents")
    docs.write(documents(spark, sf), path)
    return spark.read.parquet(path).select("doc_id", "publication_date", "lang", F.col("sha256").alias("text_hash"))


@query("S27", sql("announcements", """
SELECT DISTINCT CAST(announced_at AS DATE) AS date, true AS found FROM announcements WHERE kind = 'scheduled' UNION SELECT DISTINCT CAST(announced_at AS DATE), CAST(announced_at AS DATE) IN (SELECT CAST(announced_at AS DATE) FROM announcements WHERE kind = 'scheduled') FROM announcements WHERE kind = 'unscheduled'"""))
def dated_context_files(spark: SparkSession, sf: str) -> DataFrame:
    """Context per requested date; dates without a file are kept and marked."""
    a = announcements(spark, sf).withColumn("date", F.to_date("announced_at"))
    path = _folder(spark, "context")
    notes = a.filter("kind = 'scheduled'").select("date").distinct()
    notes.select(F.concat(F.lit("Notes for "), F.col("date").cast("string")).alias("content"), "date").write.partitionBy("date").parquet(path)
    files = spark.read.parquet(path)
    return a.select("date").distinct().join(files, "date", "left").select("date", F.col("content").isNotNull().alias("found"))


@query("J23 H9 P25 A42", sql("decisions rates", """
, probs AS (SELECT o.series_id, o.timestamp AS forecast_date, o.value AS actual, count(*) FILTER (WHERE h.value = -1) AS d, count(*) FILTER (WHERE h.value = 0) AS s, count(*) FILTER (WHERE h.value = 1) AS u
  FROM decisions o JOIN decisions h ON h.series_id = o.series_id AND h.released_at <= o.timestamp - INTERVAL 7 DAY GROUP BY 1, 2, 3 HAVING count(*) >= 3)
SELECT series_id, forecast_date, CASE WHEN d >= s AND d >= u THEN 'down' WHEN s >= u THEN 'same' ELSE 'up' END AS predicted,
  CASE WHEN (CASE WHEN d >= s AND d >= u THEN -1 WHEN s >= u THEN 0 ELSE 1 END) = actual THEN 'correct' ELSE 'incorrect' END || '_' || CASE WHEN day(forecast_date) % 2 = 0 THEN 'aligned' ELSE 'misaligned' END AS quadrant
FROM probs"""))
def rationale_alignment(spark: SparkSession, sf: str) -> DataFrame:
    """Forecast, release document and outcome joined."""
    events = decisions(spark, sf)
    releases = events.select("series_id", F.to_date("timestamp").alias("publication_date"), F.concat(F.date_format("timestamp", "yyyy-MM-dd"), F.lit("_en")).alias("doc_id"))
    p = decision_forecasts(spark, sf).withColumn("alignment", (F.dayofmonth("forecast_date") % 2 == 0).cast("double"))
    out = study.rationale_alignment(p, releases, events, category_column())
    return out.select("series_id", "forecast_date", "predicted", "quadrant")


