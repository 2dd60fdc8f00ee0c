"""Calendar arithmetic as plain Column expressions (no UDF).

Frequencies are the five offset aliases series are declared with: ``D`` days,
``B`` Monday-Friday business days, ``MS`` month starts, ``W`` Sunday weeks and
``h`` hours.  All stamps stay ``TIMESTAMP_NTZ`` and keep their time of day, so the
session time zone never enters a result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

FREQUENCIES = ("D", "B", "MS", "W", "h")

# The Monday all business-day numbers are counted from.
EPOCH_MONDAY = "1970-01-05"


def _col(x: Column | str | int) -> Column:
    if isinstance(x, Column):
        return x
    return F.col(x) if isinstance(x, str) else F.lit(x)


def ntz(x: Column | str) -> Column:
    return (F.lit(x) if isinstance(x, str) else x).cast("timestamp_ntz")


def midnight(ts: Column | str) -> Column:
    """Normalise to the start of the day, staying zone-less."""
    return F.to_date(_col(ts)).cast("timestamp_ntz")


def month_start(ts: Column | str) -> Column:
    return F.trunc(F.to_date(_col(ts)), "MM").cast("timestamp_ntz")


def plus_days(ts: Column | str, n: Column | int) -> Column:
    return F.timestamp_add("DAY", _col(n).cast("int"), _col(ts))


def plus_hours(ts: Column | str, n: Column | int) -> Column:
    return F.timestamp_add("HOUR", _col(n).cast("int"), _col(ts))


def at_hour(ts: Column | str, hour: int) -> Column:
    """A fixed time on the row's own day, e.g. 16 for the session close or 20 for an after-close origin."""
    return plus_hours(midnight(ts), hour)


def _on_date(ts: Column, date: Column) -> Column:
    """``date`` with the time of day of ``ts``."""
    return date.cast("timestamp_ntz") + (ts - midnight(ts))


def add_business_days(ts: Column | str, n: Column | int) -> Column:
    """Add ``n`` Monday-Friday days in closed form.

    A weekend start first rolls against the direction of travel (back to Friday
    going forward, on to Monday going back), so Saturday + 1 is Monday.  With
    ``n = 0`` a weekend rolls forward to Monday.
    """
    ts, n = _col(ts), _col(n).cast("int")
    dow = F.weekday(ts)
    weekend = dow > 4
    to_friday, to_monday = F.lit(4) - dow, F.lit(7) - dow
    roll = F.when(weekend, F.when(n > 0, to_friday).otherwise(to_monday)).otherwise(F.lit(0))
    start = F.when(weekend, F.when(n > 0, F.lit(4)).otherwise(F.lit(0))).otherwise(dow)
    return plus_days(ts, roll + n + F.lit(2) * F.floor((start + n) / F.lit(5)))


def add_month_starts(ts: Column | str, n: Column | int) -> Column:
    ts, n = _col(ts), _col(n).cast("int")
    steps = n + F.when((F.dayofmonth(ts) > 1) & (n <= 0), F.lit(1)).otherwise(F.lit(0))
    return _on_date(ts, F.add_months(F.trunc(F.to_date(ts), "MM"), steps))


def add_sunday_weeks(ts: Column | str, n: Column | int) -> Column:
    ts, n = _col(ts), _col(n).cast("int")
    dow = F.weekday(ts)
    forward = F.lit(6) - dow + (n - 1) * 7
    backward = -(dow + 1) + (n + 1) * 7
    on_sunday = dow == 6
    return plus_days(ts, F.when(on_sunday, n * 7).when(n < 0, backward).when(n == 0, F.lit(6) - dow).otherwise(forward))


_ADDERS = {
    "D": plus_days,
    "B": add_business_days,
    "MS": add_month_starts,
    "W": add_sunday_weeks,
    "h": plus_hours,
}


def add_periods(ts: Column | str, frequency: Column | str, n: Column | int) -> Column:
    """Add ``n`` periods of ``frequency`` (an alias, or a column of aliases) to ``ts``."""
    if isinstance(frequency, str):
        return _ADDERS[frequency](ts, n)
    out = None
    for alias, adder in _ADDERS.items():
        out = (out if out is not None else F).when(frequency == alias, adder(ts, n))
    return out.otherwise(F.raise_error(F.concat(F.lit("unknown frequency "), frequency)).cast("timestamp_ntz"))


def add_month_end(ts: Column | str) -> Column:
    """The next month end strictly after a month-end date, else this month's end (time of day kept)."""
    ts = _col(ts)
    day = F.to_date(ts)
    return _on_date(ts, F.when(day == F.last_day(day), F.last_day(F.add_months(day, 1))).otherwise(F.last_day(day)))


def month_end_release(ts: Column | str, business_days: int = 10) -> Column:
    """Conservative publication stamp of a monthly figure: month end plus some business days."""
    return add_business_days(add_month_end(ts), business_days)


def business_day_number(ts: Column | str) -> Column:
    """How many Monday-Friday days lie between the epoch Monday and ``ts`` (exclusive)."""
    days = F.datediff(F.to_date(_col(ts)), F.lit(EPOCH_MONDAY).cast("date"))
    return F.floor(days / F.lit(7)) * 5 + F.least(F.pmod(days, F.lit(7)), F.lit(5))


def business_days_between(a: Column | str, b: Column | str) -> Column:
    """Business-day steps from ``a`` to ``b``: the inclusive count minus one, never negative."""
    inclusive = business_day_number(plus_days(midnight(b), 1)) - business_day_number(a)
    return F.greatest(inclusive - 1, F.lit(0)).cast("int")


def months_between_labels(a: Column | str, b: Column | str) -> Column:
    """Whole calendar months from ``a`` to ``b`` by year and month label, ignoring days."""
    a, b = _col(a), _col(b)
    return (F.year(b) - F.year(a)) * 12 + (F.month(b) - F.month(a))


def week_ending_sunday(ts: Column | str) -> Column:
    ts = _col(ts)
    return plus_days(midnight(ts), F.lit(6) - F.weekday(ts))


def is_weekday(ts: Column | str) -> Column:
    return F.weekday(_col(ts)) < 5


def business_days_ahead(ts: Column | str, horizon: Column | int) -> Column:
    """Array of the next ``horizon`` business days after ``ts``."""
    ts = _col(ts)
    return F.transform(F.sequence(F.lit(1), _col(horizon).cast("int")), lambda i: add_business_days(ts, i))


def calendar_grid(start: Column | str, end: Column | str, frequency: Column | str) -> Column:
    """Array of on-grid stamps in ``[start, end]``, starting at the first grid date at or after ``start``."""
    start, end = _col(start), _col(end)
    fixed = isinstance(frequency, str)

    def stepped(first: Column, step: str) -> Column:
        return F.when(first <= end, F.sequence(first, end, F.expr(step))).otherwise(
            F.array().cast("array<timestamp_ntz>")
        )

    def build(alias: str) -> Column:
        if alias == "h":
            return stepped(start, "INTERVAL 1 HOUR")
        if alias == "D":
            return stepped(start, "INTERVAL 1 DAY")
        if alias == "B":
            return F.filter(stepped(start, "INTERVAL 1 DAY"), is_weekday)
        if alias == "W":
            return stepped(plus_days(start, F.lit(6) - F.weekday(start)), "INTERVAL 7 DAY")
        first = F.when(F.dayofmonth(start) == 1, start).otherwise(add_month_starts(start, 1))
        return stepped(first, "INTERVAL 1 MONTH")

    if fixed:
        return build(frequency)
    out = None
    for alias in FREQUENCIES:
        out = (out if out is not None else F).when(frequency == alias, build(alias))
    return out


def every_nth(grid: Column, stride: Column | int) -> Column:
    """Keep positions 0, stride, 2*stride, ... of an array."""
    return F.filter(grid, lambda _, i: i % _col(stride).cast("int") == 0)


def origins(specs: DataFrame) -> DataFrame:
    """Explode specs (with ``frequency``) to one row per forecast origin.

    An explicit ``origin_dates`` list wins over the strided grid.  The grid is an
    array of one spec row, so this never joins or crosses tables.
    """
    grid = every_nth(calendar_grid("start", "end", F.col("frequency")), F.col("stride"))
    chosen = F.coalesce(F.array_sort("origin_dates"), grid)
    return specs.withColumn("as_of", F.explode(chosen)).drop("origin_dates")


def mondays(start: Column | str, end: Column | str) -> Column:
    """Array of every Monday in ``[start, end]``."""
    start = _col(start)
    return F.filter(F.sequence(start, _col(end), F.expr("INTERVAL 1 DAY")), lambda d: F.weekday(d) == 0)
