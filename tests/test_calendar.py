import datetime as dt

from pyspark.sql import functions as F

from taktline.operators import calendar as cal

KEY = ("o", "f", "current")
K = "organization_id STRING, feed_id STRING, version_selector STRING"
ANCHOR = dt.date(2026, 9, 29)


def frames(spark, calendar, exceptions, info=(None, None), anchor=ANCHOR):
    archives = spark.createDataFrame([(*KEY, anchor)], f"{K}, anchor_date DATE")
    c = spark.createDataFrame(
        [(*KEY, *r, i) for i, r in enumerate(calendar)],
        f"{K}, service_id STRING, start_date DATE, end_date DATE, flags ARRAY<BOOLEAN>, row_ix BIGINT",
    )
    e = spark.createDataFrame(
        [(*KEY, *r, i) for i, r in enumerate(exceptions)],
        f"{K}, service_id STRING, date DATE, exception_type INT, row_ix BIGINT",
    )
    f = spark.createDataFrame([(*KEY, *info, 0)], f"{K}, feed_start_date DATE, feed_end_date DATE, row_ix BIGINT")
    used = spark.createDataFrame([(*KEY, "s")], f"{K}, service_id STRING")
    valid = cal.calendar_exception_valid(e, used)
    window = cal.schedule_window(archives, c, valid, f, used)
    return window, cal.latest_calendar(c, used), valid


def d(text):
    return dt.date.fromisoformat(text)


def test_window_is_cut_around_the_anchor(spark):
    window, _, _ = frames(spark, [("s", d("2020-01-01"), d("2030-01-01"), [True] * 7)], [])
    row = window.first()
    assert (row.window_start, row.window_end, row.has_calendar) == (d("2025-09-29"), d("2027-09-29"), True)


def test_window_outside_is_unknown(spark):
    window, _, _ = frames(spark, [("s", d("2020-01-01"), d("2021-01-01"), [True] * 7)], [])
    assert window.first().window_start is None and window.first().window_end is None
    window, _, _ = frames(spark, [("other", d("2026-01-01"), d("2027-01-01"), [True] * 7)], [])
    assert window.first().window_start is None and not window.first().has_calendar


def test_exceptions(spark):
    monday = [True] + [False] * 6
    days = [("s", d("2026-09-30"), 1), ("s", d("2026-09-28"), 2), ("s", d("2026-10-05"), 2),
            ("s", d("2026-10-05"), 1), ("s", d("2026-10-01"), 3), ("x", d("2026-10-02"), 1)]
    window, latest, valid = frames(spark, [("s", d("2026-09-28"), d("2026-10-12"), monday)], days)
    got = sorted(r.day for r in cal.exception_overlay(latest, valid, window).collect())
    assert got == [d("2026-09-30"), d("2026-10-05"), d("2026-10-12")]


def test_last_calendar_row_wins_even_without_dates(spark):
    every = [True] * 7
    window, latest, valid = frames(
        spark, [("s", d("2026-09-28"), d("2026-10-12"), every), ("s", None, d("2026-10-12"), every)], []
    )
    assert window.first().window_start == d("2026-09-28")
    assert cal.service_days(latest, valid, window).count() == 0


def test_weekday_number(spark):
    day = spark.createDataFrame([(d("2026-09-28"),), (d("2026-10-03"),)], "x DATE")
    assert [r[0] for r in day.select(cal.is_weekend(F.col("x"))).collect()] == [False, True]
