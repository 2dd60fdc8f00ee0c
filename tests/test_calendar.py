import itertools

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.functions import calendar as cal

OFFSETS = {
    "B": lambda n: pd.offsets.BDay(n), "MS": lambda n: pd.offsets.MonthBegin(n), "D": lambda n: pd.Timedelta(days=n),
    "h": lambda n: pd.Timedelta(hours=n), "W": lambda n: pd.offsets.Week(n, weekday=6),
}
DAYS = [d + pd.Timedelta(hours=h) for d in pd.date_range("2023-12-20", "2024-03-10") for h in (0, 20)]


@pytest.mark.parametrize("freq,steps", [("B", (-7, -5, -1, 1, 2, 5, 6, 13)), ("MS", (-2, -1, 1, 3)), ("W", (-2, -1, 1, 2)), ("D", (-3, 4)), ("h", (-5, 30))])
def test_add_periods_matches_pandas(spark, freq, steps):
    pairs = [(d.to_pydatetime(), n) for d, n in itertools.product(DAYS, steps)]
    df = spark.createDataFrame(pairs, "ts timestamp_ntz, n int").withColumn("got", cal.add_periods("ts", freq, F.col("n")))
    wrong = [(r.ts, r.n, r.got) for r in df.collect() if r.got != (pd.Timestamp(r.ts) + OFFSETS[freq](r.n)).to_pydatetime()]
    assert not wrong, wrong[:3]


def test_frequency_may_be_a_column(spark):
    df = spark.createDataFrame([(d.to_pydatetime(), f) for d in DAYS[:20] for f in OFFSETS], "ts timestamp_ntz, f string")
    for r in df.withColumn("got", cal.add_periods("ts", F.col("f"), 2)).collect():
        assert r.got == (pd.Timestamp(r.ts) + OFFSETS[r.f](2)).to_pydatetime()


def test_month_end_and_release(spark):
    df = spark.createDataFrame([(d.to_pydatetime(),) for d in DAYS], "ts timestamp_ntz")
    for r in df.select("ts", cal.add_month_end("ts").alias("e"), cal.month_end_release("ts").alias("p")).collect():
        end = pd.Timestamp(r.ts) + pd.offsets.MonthEnd(1)
        assert r.e == end.to_pydatetime()
        assert r.p == (end + pd.offsets.BDay(10)).to_pydatetime()


def test_business_day_distance(spark):
    pairs = [(a.to_pydatetime(), b.to_pydatetime()) for a, b in itertools.product(DAYS[::5], DAYS[::7])]
    df = spark.createDataFrame(pairs, "a timestamp_ntz, b timestamp_ntz").withColumn("n", cal.business_days_between("a", "b"))
    for r in df.collect():
        want = max(len(pd.bdate_range(pd.Timestamp(r.a).normalize(), pd.Timestamp(r.b).normalize())) - 1, 0)
        assert r.n == want


@pytest.mark.parametrize("freq,alias", [("B", "B"), ("MS", "MS"), ("W", "W-SUN"), ("D", "D")])
@pytest.mark.parametrize("start", ["2024-01-01", "2024-01-06", "2024-01-17"])
def test_grid_matches_date_range(spark, freq, alias, start):
    row = spark.range(1).select(cal.calendar_grid(cal.ntz(start), cal.ntz("2024-05-02"), freq).alias("g")).first()
    assert row.g == [t.to_pydatetime() for t in pd.date_range(start, "2024-05-02", freq=alias)]


def test_empty_grid(spark):
    assert spark.range(1).select(cal.calendar_grid(cal.ntz("2024-01-03"), cal.ntz("2024-01-20"), "MS").alias("g")).first().g == []


def test_strided_origins(spark):
    """Month starts 2010-01 .. 2012-01 by six: five origins."""
    spec = spark.createDataFrame([("s", 6)], "spec_id string, stride int").select(
        "*", cal.ntz("2010-01-01").alias("start"), cal.ntz("2012-01-01").alias("end"), F.lit("MS").alias("frequency"),
        F.lit(None).cast("array<timestamp_ntz>").alias("origin_dates"),
    )
    got = [r.as_of.strftime("%Y-%m") for r in cal.origins(spec).orderBy("as_of").collect()]
    assert got == ["2010-01", "2010-07", "2011-01", "2011-07", "2012-01"]


def test_week_label(spark):
    df = spark.sql("select explode(array(timestamp_ntz'2025-01-13', timestamp_ntz'2025-01-19', timestamp_ntz'2025-01-20')) as t")
    assert [str(r.w)[:10] for r in df.select(cal.week_ending_sunday("t").alias("w")).collect()] == ["2025-01-19", "2025-01-19", "2025-01-26"]
