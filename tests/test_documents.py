import json

import pytest
from pyspark.sql import functions as F

from helpers import observations, ts
from tidemark.functions import text as tx
from tidemark.sources import canonical as src, documents as docs, store


def fenced(spark, text, cutoff):
    df = spark.createDataFrame([(text, cutoff)], "t string, c string")
    return df.select(tx.fence(F.col("t"), tx.parse_cutoff(F.col("c"))).alias("f")).first().f


FIXTURE = "In April 2025, NVIDIA faced export curbs. March 2025 was volatile.\n- The U.S. Commerce Dept. on Apr. 3, 2025 set rules. Shares fell on 27 January 2025."


def test_fence_fixture(spark):
    f = fenced(spark, FIXTURE, "2025-04-03")
    assert f.kept == "March 2025 was volatile.\n- Shares fell on 27 January 2025."
    assert f.dropped == ["In April 2025, NVIDIA faced export curbs.", "The U.S. Commerce Dept. on Apr. 3, 2025 set rules."]


@pytest.mark.parametrize(
    "text,cutoff,kept",
    [
        ("Seen on 2025-04-02. Seen on 2025-04-03.", "2025-04-03", "Seen on 2025-04-02."),
        ("On February 30, 2025 nothing. Fine.", "2025-03-01", "On February 30, 2025 nothing. Fine."),
        ("1. On 3rd of April 2025 up! Ok.\n\n> May 2026 only.", "2025-04-03", "1. Ok.\n"),
        ("Anything 2030-01-01.", "not a date", "Anything 2030-01-01."),
        ("A\nB\n", "2025-01-01", "A\nB"),
        ("On April\u00a03,\u202f2025 up. Ok.", "2025-04-03", "Ok."),
        ("On April\u00a02, 2025 up. Ok.", "2025-04-03", "On April\u00a02, 2025 up. Ok."),
    ],
)
def test_fence_cases(spark, text, cutoff, kept):
    assert fenced(spark, text, cutoff).kept == kept


def test_retrospective(spark):
    df = spark.createDataFrame([("2024-01-01",), ("2024-01-02",), ("junk",)], "c string")
    assert [r.r for r in df.select(tx.is_retrospective(F.col("c"), F.lit("2024-01-02").cast("date")).alias("r")).collect()] == [True, False, True]


HTML = """<html><head><title>x</title><script>var a="<p>no</p>";</script></head><body><nav>Menu</nav><header>Top</header>
<main><h1>Decision</h1><p>The Bank held its rate &amp; said so.</p><p>Share this page on X</p><aside>ad</aside><form>f</form>
<div>More text</div>
<p>Content Type(s): Press</p><p>Related</p></main><footer>End</footer></body></html>"""


def test_html_main_text(spark):
    df = spark.createDataFrame([(HTML,), ("<p>Only <b>body</b></p>",), (None,)], "html string")
    got = [r.t for r in df.select(tx.extract_main_text("html").alias("t")).collect()]
    assert got[0] == "Decision\nThe Bank held its rate & said so.\nMore text" and got[1] == "Only\nbody" and got[2] is None


def test_first_json_object(spark):
    cases = ['```json\n{"a": {"b": 1}}\n```', 'see {this} then {"a": 2} and {"a": 3}', "none", None]
    df = spark.createDataFrame([(c,) for c in cases], "t string")
    assert [r.j for r in df.select(tx.first_json_object("t").alias("j")).collect()] == ['{"a": {"b": 1}}', '{"a": 2}', None, None]


def test_scan_documents(spark, tmp_path):
    art = lambda i, day, text="", **kw: json.dumps({"meta": {"doc_id": i, "publication_date": day, "title": "T"}, "text": text, "page_count": 1, **kw})
    (tmp_path / "a.json").write_text(art("a", "2024-01-05", "inline"))
    (tmp_path / "b.json").write_text(art("b", "2024-02-05", extracted_at="2024-03-01T10:00:00"))
    (tmp_path / "b.md").write_text("from\ncompanion")
    (tmp_path / "c.json").write_text(art("c", "2024-03-05", text_path="elsewhere/other.md"))
    (tmp_path / "other.md").write_text("by path")
    (tmp_path / "bad.json").write_text("{not json")
    got = {r.doc_id: r for r in docs.scan(spark, str(tmp_path), "s").collect()}
    assert {k: r.text for k, r in got.items()} == {"a": "inline", "b": "from\ncompanion", "c": "by path"}
    assert got["b"].n_chars == 14 and got["b"].lang == "en"
    assert docs.visible(docs.scan(spark, str(tmp_path), "s"), as_of="2024-02-05").count() == 2


def test_dated_files(spark, tmp_path):
    (tmp_path / "news_2024-03-04.md").write_text("x")
    (tmp_path / "aaa_2024-03-04.md").write_text("first")
    dates = spark.sql("select explode(array(date'2024-03-04', date'2024-03-11')) as date")
    assert {str(r.date): r.content for r in docs.dated_files(spark, str(tmp_path), dates).collect()} == {"2024-03-04": "first", "2024-03-11": None}


def test_register_replaces_only_its_series(spark, tmp_path):
    path = str(tmp_path / "store")
    meta = lambda *ids: spark.createDataFrame([(i, "d") for i in ids], "series_id string, description string")
    store.register(observations(spark, [("a", "2024-01-01", 1, None), ("b", "2024-01-01", 2, None)]), meta("a", "b"), path)
    store.register(observations(spark, [("b", "2024-01-02", 3, None), ("c", "2024-01-02", 4, None)]), meta("b", "c"), path)
    assert sorted((r.series_id, r.value) for r in store.series(spark, path).collect()) == [("a", 1.0), ("b", 3.0), ("c", 4.0)]
    assert [r.value for r in store.series(spark, path, "b").collect()] == [3.0]
    assert {r.series_id: r.n_obs for r in store.summary(store.series(spark, path), store.metadata(spark, path)).collect()} == {"a": 1, "b": 1, "c": 1}


def test_wide_table_fixture(spark, tmp_path):
    (tmp_path / "t.csv").write_text(
        "REF_DATE,GEO,Products,VALUE\n" + "".join(f"{m},{g},{p},{v}\n" for m, g, p, v in [
            ("2022-01", "Canada", "All-items", "151.2"), ("2022-01", "Canada", "Food", "160"), ("2022-01", "Ontario", "All-items", "150"),
            ("2022-02", "Canada", "All-items", "152.4"), ("2022-02", "Canada", "Food", ""), ("bad", "Ontario", "All-items", "1")])
    )
    wide = src.wide_table(spark, str(tmp_path / "t.csv"), ["REF_DATE", "GEO", "Products", "VALUE"])
    members = spark.createDataFrame([("cpi", "Canada", "All-items"), ("food", "Canada", "Food")], "series_id string, GEO string, Products string")
    rows = src.select_members(wide, members, ["GEO", "Products"]).orderBy("series_id", "timestamp").collect()
    assert [(r.series_id, r.value, (r.released_at - r.timestamp).days) for r in rows] == [("cpi", 151.2, 21), ("cpi", 152.4, 21), ("food", 160.0, 21)]
    key = spark.createDataFrame([("18-10-0004-13", "^GSPC_Adj Close_1d")], "a string, b string").select(src.table_id(F.col("a")).alias("t"), src.safe_key(F.col("b")).alias("k")).first()
    assert (key.t, key.k) == ("18100004", "gspc_adj_close_1d")


def test_cache_range(spark):
    obs = observations(spark, [("a", "2005-01-03", 1, None), ("a", "2005-02-01", 1, None)])
    ok = lambda a, b: src.covers_range(obs, a, b).first().covered
    assert ok("2005-01-01", "2005-02-02") and not ok("2004-12-31", "2005-02-02") and not ok("2005-01-01", "2005-02-04")


def test_spend_uses_dearest_rate(spark):
    usage = spark.createDataFrame([("m", 100, 10, 1), ("other", 100, 10, 0)], "model string, tokens_in int, tokens_out int, searches int")
    rates = spark.createDataFrame([("m", 0.1, 0.2), ("big", 1.0, 2.0)], "model string, price_in double, price_out double")
    got = {r.model: (r.usd, r.priced) for r in store.spend(usage, rates, 0.5).collect()}
    assert got == {"m": (pytest.approx(12.5), True), "other": (pytest.approx(120.0), False)}


def test_trail_marks_the_newest(spark):
    e = spark.createDataFrame([("p", ts("2024-01-01"), 1), ("p", ts("2024-02-01"), 2), ("q", ts("2024-01-01"), 3)], "pattern_id string, evaluated_on timestamp_ntz, v int")
    assert sorted(r.v for r in store.current(e).collect()) == [2, 3]


def test_stream_append(spark, tmp_path):
    from tidemark.streaming import ingest

    rows = observations(spark, [("a", "2024-01-01", 1, "2024-01-02"), ("a", "2024-01-02", float("nan"), "2024-01-03")])
    rows.write.parquet(str(tmp_path / "in"))
    q = ingest.append(ingest.landed(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "cp"), once=True)
    q.awaitTermination(60)
    assert [r.value for r in spark.read.parquet(str(tmp_path / "out")).collect()] == [1.0]


def test_compressed_history(spark):
    import pandas as pd

    days = pd.bdate_range("2023-01-02", "2024-01-31")
    obs = observations(spark, [("a", d.strftime("%Y-%m-%d"), float(i), None) for i, d in enumerate(days)])
    got = {(r.grain, r.day): r.value for r in tx.compressed_history(obs).collect()}
    s = pd.Series(range(len(days)), index=days, dtype=float)
    cut = days.max() - pd.DateOffset(months=6)
    want = {("weekly", d.date()): v for d, v in s[s.index < cut].resample("W").mean().dropna().items()} | {("daily", d.date()): v for d, v in s[s.index >= cut].items()}
    assert got == pytest.approx(want)


def test_preamble_in_date_order(spark):
    d = spark.sql(
        "select 's' as source, 'b' as doc_id, date'2024-02-01' as publication_date, 'Title' as title, 'xyz' as text, 'k' as k "
        "union all select 's', 'a', date'2024-01-01', null, 'abcdef', 'k'"
    )
    assert tx.report_preamble(d, ["k"], 4).first().preamble == (
        "=== s/a ===\nSource: s\nPublished: 2024-01-01\n\nabcd\n\n[...]\n\n=== Title ===\nSource: s\nPublished: 2024-02-01\n\nxyz"
    )


def test_unclosed_furniture_ends_with_what_holds_it():
    assert tx.main_text("<header><nav>menu</header><main>hello world</main>") == "hello world"
