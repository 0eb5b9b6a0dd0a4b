"""Dates, periods and calendars as Column functions and small DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Spanish names of the months.
MONTHS_ES = ("enero", "febrero", "marzo", "abril", "mayo", "junio", "julio", "agosto", "septiembre", "octubre", "noviembre", "diciembre")


def mixed_utc_date(c: Column) -> Column:
    """Date in UTC of a text that is a date, or a date and time with or without zone; NULL if unusable."""
    return F.coalesce(F.try_to_timestamp(c), F.try_to_timestamp(c, F.lit("yyyy-MM-dd'T'HH:mm:ss[XXX]")), F.try_to_timestamp(c, F.lit("yyyy-MM-dd"))).cast("date")


def quarter_label(d: Column) -> Column:
    """``2024Q1``"""
    return F.concat(F.year(d).cast("string"), F.lit("Q"), F.quarter(d).cast("string"))


def period_start(d: Column, unit: str) -> Column:
    """First day of the month, year, quarter or Monday week of a date."""
    return F.trunc(d, unit)


def months_before(d: Column, n: int) -> Column:
    """``n`` months earlier; a day that the month lacks becomes its last day."""
    return F.add_months(d, -n)


def calendar(spark: SparkSession, start: str, end: str, step: str = "1 day", name: str = "date") -> DataFrame:
    """Days from ``start`` to ``end``, both included, every ``step`` counted from ``start``."""
    return spark.range(1).select(F.explode(F.expr(f"sequence(DATE'{start}', DATE'{end}', INTERVAL {step})")).alias(name))


def date_windows(spark: SparkSession, start: str, end: str, days: int) -> DataFrame:
    """(window_no, from_date, to_date): a range cut into windows of ``days`` days; the last may be shorter."""
    w = calendar(spark, start, end, f"{days} day", "from_date")
    return w.select((F.row_number().over(_by("from_date"))).alias("window_no"), "from_date", F.least(F.date_add("from_date", days - 1), F.to_date(F.lit(end))).alias("to_date"))


def _by(c: str):
    from pyspark.sql import Window

    return Window.orderBy(c)


def is_business_day(d: Column) -> Column:
    return F.weekday(d) < 5


def business_index(d: Column) -> Column:
    """Number of the business day of a date, counted from Monday 1970-01-05; a weekend has that of its Friday."""
    n = F.datediff(d, F.to_date(F.lit("1970-01-05")))
    return (F.floor(n / 7) * 5 + F.least(F.pmod(n, F.lit(7)), F.lit(4))).cast("int")


def business_add(d: Column, k: int) -> Column:
    """The ``k``-th business day after a business day (before it, for a negative ``k``)."""
    i = business_index(d) + k
    return F.date_add(F.to_date(F.lit("1970-01-05")), (F.floor(i / 5) * 7 + F.pmod(i, F.lit(5))).cast("int"))


def serial_date(n: Column) -> Column:
    """Date of a spreadsheet's serial number, counted from 1899-12-30."""
    return F.date_add(F.to_date(F.lit("1899-12-30")), n.cast("int"))


def capture_time(c: Column) -> Column:
    """Timestamp of a 14-figure capture stamp, also one that came through a float (``20250103000000.0``)."""
    return F.try_to_timestamp(F.regexp_replace(F.trim(c), r"\.0+$", ""), F.lit("yyyyMMddHHmmss"))


def url_date(c: Column) -> Column:
    """Date in the path of a URL: /2023/11/22/ or /2023-11-22."""
    g = lambda k: F.nullif(F.regexp_extract(c, r"/((?:19|20)\d{2})[/-](\d{2})[/-](\d{2})(?:[/_.-]|$)", k), F.lit("")).cast("int")
    return F.try_make_date(g(1), g(2), g(3)) if hasattr(F, "try_make_date") else F.to_date(F.try_to_timestamp(F.concat_ws("-", *[F.lpad(g(k).cast("string"), 4 if k == 1 else 2, "0") for k in (1, 2, 3)]), F.lit("yyyy-MM-dd")))


def spanish_date(c: Column) -> Column:
    """Date of a text like ``4 de julio de 2022`` anywhere in it; NULL if there is none or it does not exist."""
    pattern = r"(?i)(\d{1,2}) de (" + "|".join(MONTHS_ES) + r") de (\d{4})"
    g = lambda k: F.regexp_extract(c, pattern, k)
    month = F.array_position(F.array(*[F.lit(m) for m in MONTHS_ES]), F.lower(g(2)))
    text = F.concat_ws("-", g(3), F.lpad(month.cast("string"), 2, "0"), F.lpad(g(1), 2, "0"))
    return F.when(g(1) != "", F.try_to_timestamp(text, F.lit("yyyy-MM-dd")).cast("date"))


def day_month_near(day: Column, month: Column, seen: Column) -> Column:
    """Date of a day and month without year: the latest such date not after ``seen``."""
    at = lambda y: F.try_to_timestamp(F.concat_ws("-", y.cast("string"), F.lpad(month.cast("string"), 2, "0"), F.lpad(day.cast("string"), 2, "0")), F.lit("yyyy-MM-dd")).cast("date")
    this = at(F.year(seen))
    return F.when(this <= seen, this).otherwise(at(F.year(seen) - 1))
