from datetime import UTC, datetime
from zoneinfo import ZoneInfo

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from panelwright.operators.timestamps import with_utc_seconds

MX, US, ES = "America/Mexico_City", "America/New_York", "Europe/Madrid"


def run(spark, rows):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, value string, tz string, us boolean")
    got = {r["i"]: r["utc_s"] for r in with_utc_seconds(df, "value", tz="tz", month_first="us").collect()}
    return [got[i] for i in range(len(rows))]


def local(tz, *args, fold=0):
    return int(datetime(*args, tzinfo=ZoneInfo(tz), fold=fold).timestamp())


def utc(*args):
    return int(datetime(*args, tzinfo=UTC).timestamp())


def test_writings(spark):
    cases = [
        ("2025-11-07T07:51", MX, False, local(MX, 2025, 11, 7, 7, 51)), ("1708690637", MX, False, 1708690637), ("1723027285978", MX, False, 1723027285),
        ("2024-10-12T20:26:57.4869124-06:00", ES, False, utc(2024, 10, 13, 2, 26, 57)), ("20230319T095033Z", MX, False, utc(2023, 3, 19, 9, 50, 33)),
        ("20220115021252.0", US, True, local(US, 2022, 1, 15, 2, 12, 52)), ("12-03-24 08:15", MX, False, local(MX, 2024, 3, 12, 8, 15)),
        ("09/01/2022 6:00 PM", US, True, local(US, 2022, 9, 1, 18)), ("09/01/2022", ES, False, local(ES, 2022, 1, 9)), ("18/02/2024 12:30 a.m.", MX, False, local(MX, 2024, 2, 18, 0, 30)),
        ("Thu, 16 Sep 2021 15:02:45 -0400", ES, False, utc(2021, 9, 16, 19, 2, 45)), ("2022-05-07 14:45:42 EST", "America/Cancun", False, utc(2022, 5, 7, 19, 45, 42)),
        ("Publicado el 12 sep. 2026 - 3:28 p.m.", MX, False, local(MX, 2026, 9, 12, 15, 28)), ("4 de julio de 2022, 09:29 h", MX, False, local(MX, 2022, 7, 4, 9, 29)),
        ("26 de junho de 2026 às 19h17", "America/Sao_Paulo", False, local("America/Sao_Paulo", 2026, 6, 26, 19, 17)), ("2021-05-11T08:49:33[Europe/Madrid]", MX, False, local(ES, 2021, 5, 11, 8, 49, 33)),
        ("06/06/2023 20:50 GMT-06:00", ES, False, utc(2023, 6, 7, 2, 50)), ("05/04/2023 08:20 (UTC-05:00)", ES, False, utc(2023, 4, 5, 13, 20)), ("2020-12-09 20:51:23 GMT-5", ES, False, utc(2020, 12, 10, 1, 51, 23)),
        ("June 26, 2025 at 1:10 PM", US, True, local(US, 2025, 6, 26, 13, 10)), ("  2021-05-04 ", ES, False, local(ES, 2021, 5, 4)), ("20220111T1233Z", US, True, utc(2022, 1, 11, 12, 33)),
    ]
    assert run(spark, [c[:3] for c in cases]) == [c[3] for c in cases]


def test_no_dates_are_null(spark):
    rows = [(v, MX, False) for v in (None, "", "  ", "ayer", "31/02/2024", "0000-00-00 00:00:00", "2023-05-01 25:00", "hace 3 horas", "n/a", "13/13/2024", "x" * 5000, "29/02/2023", "2024-1")]
    assert run(spark, rows) == [None] * len(rows)


def test_changes_of_the_clock(spark):
    rows = [("2023-11-05T01:30:00", US, False), ("2023-03-12T02:30:00", US, False), ("2024-03-31 02:30:00", ES, False), ("2023-11-05T01:30:00", "Nowhere/Else", False), ("2023-11-05T01:30:00", None, None)]
    # The earlier of two moments; the offset before the change for a skipped time; UTC for an unknown zone.
    assert run(spark, rows) == [local(US, 2023, 11, 5, 1, 30, fold=0), utc(2023, 3, 12, 7, 30), utc(2024, 3, 31, 1, 30), utc(2023, 11, 5, 1, 30), utc(2023, 11, 5, 1, 30)]


def test_columns_stay_and_empty_table(spark):
    df = spark.createDataFrame([("2024-01-01", "a", 1)], "value string, tz string, utc string").withColumnRenamed("utc", "other")
    assert with_utc_seconds(df, "value").columns == ["value", "tz", "other", "utc_s"]
    assert with_utc_seconds(df.limit(0), "value").count() == 0


@settings(max_examples=3, deadline=None)
@given(st.lists(st.datetimes(datetime(1975, 1, 1), datetime(2090, 1, 1)), min_size=20, max_size=60))
def test_local_times_against_the_zone_database(spark, times):
    rows = [(t.strftime("%Y-%m-%d %H:%M:%S"), US, False) for t in times if t.year < 2037]
    want = []
    for t in times:
        if t.year < 2037:
            a = t.replace(microsecond=0, tzinfo=ZoneInfo(US))
            want.append(int(a.timestamp()))
    assert run(spark, rows) == want if rows else True


def test_constant_zone_needs_no_column(spark):
    df = spark.createDataFrame([("2024-01-01T00:00:00",)], "value string")
    assert with_utc_seconds(df.withColumn("z", F.lit("UTC")), "value", tz="z").first()["utc_s"] == utc(2024, 1, 1)
