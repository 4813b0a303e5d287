"""Service calendars: evaluation window, active days, exceptions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from taktline.constants import ARCHIVE_KEYS, WINDOW_DAYS

A = list(ARCHIVE_KEYS)
WORD_WEEKS = 9  # weeks of a 64-bit word, 7 bits each
WORDS = (2 * WINDOW_DAYS // 7 + 3 + WORD_WEEKS - 1) // WORD_WEEKS  # a window never meets itself when words begin again
WORD_WEEKDAYS = sum(1 << (7 * week + day) for week in range(WORD_WEEKS) for day in range(5))
SERVICE = [*A, "service_id"]


def calendar_exception_valid(calendar_dates: DataFrame, used_services: DataFrame) -> DataFrame:
    """Exceptions of known services with a date and type 1 or 2."""
    return calendar_dates.where(
        F.col("date").isNotNull() & F.col("exception_type").isin(1, 2)
    ).join(used_services, SERVICE, "left_semi")


def latest_calendar(calendar: DataFrame, used_services: DataFrame) -> DataFrame:
    """Calendar row per used service; the last source row wins."""
    return calendar.join(used_services, SERVICE, "left_semi").groupBy(*SERVICE).agg(
        F.max_by(F.struct("start_date", "end_date", "flags"), "row_ix").alias("_c")
    ).select(*SERVICE, "_c.start_date", "_c.end_date", "_c.flags")


def first_feed_info(feed_info: DataFrame) -> DataFrame:
    """First row of the feed information table."""
    return feed_info.groupBy(*A).agg(
        F.min_by(F.struct("feed_start_date", "feed_end_date"), "row_ix").alias("_f")
    ).select(*A, "_f.feed_start_date", "_f.feed_end_date")


def schedule_window(
    archives: DataFrame,
    calendar: DataFrame,
    exceptions: DataFrame,
    feed_info: DataFrame,
    used_services: DataFrame,
    days: int = WINDOW_DAYS,
) -> DataFrame:
    """Evaluation window per archive, cut to ``days`` around its anchor date.

    ``archives`` carries one ``anchor_date`` per archive, ``exceptions`` are
    already valid. NULL, NULL when no date is known or the window is empty.
    """
    used = calendar.join(used_services, SERVICE, "left_semi")
    sources = [
        used.groupBy(*A).agg(
            F.min(F.least("start_date", "end_date")).alias("lo"),
            F.max(F.greatest("start_date", "end_date")).alias("hi"),
            F.lit(True).alias("dated"),
        ),
        exceptions.groupBy(*A).agg(
            F.min("date").alias("lo"), F.max("date").alias("hi"), F.lit(True).alias("dated")
        ),
        first_feed_info(feed_info).select(
            *A,
            F.least("feed_start_date", "feed_end_date").alias("lo"),
            F.greatest("feed_start_date", "feed_end_date").alias("hi"),
            F.lit(False).alias("dated"),
        ),
    ]
    ranges = sources[0].unionByName(sources[1]).unionByName(sources[2]).groupBy(*A).agg(
        F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.bool_or("dated").alias("has_calendar")
    )
    start = F.when(
        F.col("lo").isNotNull(), F.greatest(F.date_sub("anchor_date", days), F.col("lo"))
    )
    end = F.when(F.col("hi").isNotNull(), F.least(F.date_add("anchor_date", days), F.col("hi")))
    return archives.select(*A, "anchor_date").join(ranges, A, "left").select(
        *A,
        F.when(start <= end, start).alias("window_start"),
        F.when(start <= end, end).alias("window_end"),
        F.coalesce("has_calendar", F.lit(False)).alias("has_calendar"),
    )


def is_weekend(day: Column) -> Column:
    return F.weekday(day) >= 5


def day_words(days: Column) -> list[Column]:
    """The days of one window as bits of ``WORDS`` words, Monday first in each week; sets are joined by ``bit_or``."""
    monday = F.lit("1969-12-29").cast("date")

    def place(day: Column) -> Column:
        return F.pmod(F.date_diff(day, monday), F.lit(7 * WORD_WEEKS * WORDS))

    places = F.transform(days, place)
    bits = 7 * WORD_WEEKS

    def word(number: int) -> Column:
        own = F.filter(places, lambda at: F.floor(at / bits) == number)
        return F.aggregate(
            own, F.lit(0).cast("bigint"),
            lambda found, at: found.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("bigint"), at % bits)))

    return [word(i) for i in range(WORDS)]


def regular_days(start: Column, end: Column, flags: Column, lo: Column, hi: Column) -> Column:
    """Days of a weekly calendar inside the window, as an array.

    The bounds are cut before the days are made, so it has at most one entry
    per day of the window.
    """
    first, last = F.greatest(start, lo), F.least(end, hi)
    usable = start.isNotNull() & end.isNotNull() & lo.isNotNull() & (first <= last)
    days = F.sequence(first, last)
    return F.when(usable, F.filter(days, lambda d: F.get(flags, F.weekday(d)))).otherwise(
        F.array().cast("array<date>")
    )


def calendar_day_range_join(latest: DataFrame, window: DataFrame) -> DataFrame:
    """One row per service and regular day of the window."""
    days = regular_days(
        F.col("start_date"), F.col("end_date"), F.col("flags"),
        F.col("window_start"), F.col("window_end"),
    )
    return latest.join(window, A).select(*SERVICE, F.explode(days).alias("day"))


def exception_days(exceptions: DataFrame, window: DataFrame) -> DataFrame:
    """Added and removed days per service; the last row of a day wins.

    A service has at most one entry per day of the window, which bounds the
    two arrays.
    """
    last = exceptions.groupBy(*SERVICE, "date").agg(
        F.max_by("exception_type", "row_ix").alias("exception_type")
    )
    inside = last.join(window, A).where(F.col("date").between(F.col("window_start"), F.col("window_end")))
    return inside.groupBy(*SERVICE).agg(
        F.collect_list(F.when(F.col("exception_type") == 1, F.col("date"))).alias("added"),
        F.collect_list(F.when(F.col("exception_type") == 2, F.col("date"))).alias("removed"),
    )


def service_days(latest: DataFrame, exceptions: DataFrame, window: DataFrame) -> DataFrame:
    """Active days per service: regular days, plus added, minus removed.

    One row per service with an array no longer than the window. Nothing is
    expanded to days before it has to be.
    """
    regular = latest.join(window, A).select(
        *SERVICE,
        regular_days(
            F.col("start_date"), F.col("end_date"), F.col("flags"),
            F.col("window_start"), F.col("window_end"),
        ).alias("regular"),
    )
    none = F.array().cast("array<date>")
    days = F.array_union(
        F.array_except(F.coalesce("regular", none), F.coalesce("removed", none)),
        F.coalesce("added", none),
    )
    return regular.join(exception_days(exceptions, window), SERVICE, "full").select(
        *SERVICE, days.alias("days")
    ).where(F.size("days") > 0)


def exception_overlay(latest: DataFrame, exceptions: DataFrame, window: DataFrame) -> DataFrame:
    """One row per service and active day."""
    return service_days(latest, exceptions, window).select(*SERVICE, F.explode("days").alias("day"))
