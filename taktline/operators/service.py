"""Service level per agency and per operator."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame, functions as F

from taktline.constants import ARCHIVE_KEYS
from taktline.functions import (
    canonical_operator, fmt_time, gtfs_seconds, operator_id, prefecture_name, strip,
)
from taktline.operators import calendar as cal, routes as rt, trips as tr
from taktline.operators.ordering import dealt
from taktline.workspace import Lazy, Workspace

A = list(ARCHIVE_KEYS)
AGENCY = [*A, "agency_id"]
AGENCY_SERVICE = [*AGENCY, "service_id"]


@dataclass(frozen=True)
class Timetable:
    """Typed tables of any number of archives; see ``taktline.schemas``.

    Anything with these attributes will do.
    """

    archives: DataFrame
    agency: DataFrame
    routes: DataFrame
    trips: DataFrame
    stops: DataFrame
    stop_times: DataFrame
    calendar: DataFrame
    calendar_dates: DataFrame
    feed_info: DataFrame


def _service_set() -> list[Column]:
    """Name of the set of services of a group: its size and two 64-bit hashes that do not depend on the order."""
    service = F.col("service_id")
    return [
        F.count("*").alias("n"),
        F.bit_xor(F.xxhash64(service)).alias("x1"),
        F.bit_xor(F.xxhash64(F.lit("second"), service)).alias("x2"),
    ]


class ServiceModel:
    """The steps of the service metrics, shared by all results built on them.

    Totals per agency and service come before days: an archive has few services
    and up to 731 days. ``workspace`` keeps the tables that several steps read;
    with the default every step is a plan of its own and no action runs.
    """

    def __init__(self, timetable: Timetable, workspace: Workspace | Lazy = Lazy(), **block_args: int):
        self.timetable = timetable
        self.workspace = workspace
        self._block_args = block_args

    def _ahead(self, *names: str) -> None:
        """Make steps that do not need each other side by side, those that are not made yet."""
        missing = [n for n in names if n not in self.__dict__]
        if missing and not isinstance(self.workspace, Lazy):
            self.workspace.together(*(lambda n=n: getattr(self, n) for n in missing))

    @cached_property
    def _agency_ids(self) -> DataFrame:
        return rt.archive_agency_ids(self.timetable.agency)

    @cached_property
    def agency_names(self) -> DataFrame:
        return rt.agency_names(self.timetable.agency, self._agency_ids)

    @cached_property
    def bus_routes(self) -> DataFrame:
        return rt.bus_routes_only(self.timetable.routes, self._agency_ids)

    @cached_property
    def bus_trips(self) -> DataFrame:
        joined = rt.join_trips_routes(self.timetable.trips, self.bus_routes)
        return self.workspace.keep(joined, "bus_trips")

    @cached_property
    def trip_lookup(self) -> DataFrame:
        return rt.trip_lookup(self.bus_trips)

    @cached_property
    def _blocks(self) -> tuple[DataFrame, DataFrame]:
        return tr.trip_blocks(self.timetable.stop_times, workspace=self.workspace, **self._block_args)

    @cached_property
    def _trip_facts(self) -> tuple[DataFrame, DataFrame]:
        self._ahead("bus_trips", "_blocks")
        t = self.timetable
        return tr.trip_facts(
            t.stop_times, self.trip_lookup, workspace=self.workspace, blocks=self._blocks, stops=t.stops)

    @cached_property
    def spans(self) -> DataFrame:
        return self.workspace.keep(self._trip_facts[0], "spans")

    @cached_property
    def segments(self) -> DataFrame:
        return self.workspace.keep(self._trip_facts[1], "segments")

    @cached_property
    def used_services(self) -> DataFrame:
        return self.agency_services.select(*cal.SERVICE).distinct()

    @cached_property
    def agency_services(self) -> DataFrame:
        """Trip rows per agency and service."""
        services = self.bus_trips.groupBy(*AGENCY_SERVICE).agg(F.count("*").alias("trips"))
        return self.workspace.keep(services, "agency_services")

    @cached_property
    def exceptions(self) -> DataFrame:
        return cal.calendar_exception_valid(self.timetable.calendar_dates, self.used_services)

    @cached_property
    def calendar(self) -> DataFrame:
        return cal.latest_calendar(self.timetable.calendar, self.used_services)

    @cached_property
    def window(self) -> DataFrame:
        t = self.timetable
        return cal.schedule_window(
            t.archives, t.calendar, self.exceptions, t.feed_info, self.used_services
        )

    @cached_property
    def service_days(self) -> DataFrame:
        days = cal.service_days(self.calendar, self.exceptions, self.window)
        return self.workspace.keep(days, "service_days")

    # -- totals ---------------------------------------------------------------

    def agency_static_counts(self) -> DataFrame:
        """Routes, trips, stops, services and route types per agency."""
        by_route = self.bus_routes.groupBy(*AGENCY).agg(
            F.count_distinct("route_id").alias("route_count"),
            # Distinct route types are at most 102: bounded by the type range.
            F.array_join(
                F.transform(
                    F.array_sort(
                        F.transform(
                            F.collect_set("route_type"),
                            lambda x: F.struct(x.cast("int").alias("n"), x.alias("text")),
                        )
                    ),
                    lambda s: s["text"],
                ),
                "|",
            ).alias("route_types"),
            F.min("row_ix").alias("source_ix"),
        )
        by_trip = self.bus_trips.groupBy(*AGENCY).agg(
            F.count("*").alias("trip_count"),
            F.count_distinct("service_id").alias("service_id_count"),
        )
        by_stop = self.segments.groupBy(*AGENCY).agg(
            F.count_distinct("to_stop").alias("stop_count")
        )
        counts = by_route.join(by_trip, AGENCY, "left").join(by_stop, AGENCY, "left")
        zero = ["trip_count", "service_id_count", "stop_count"]
        return counts.fillna(0, zero)

    @cached_property
    def service_hours(self) -> DataFrame:
        """Trips, seconds, first and last time per agency and service.

        Time is added up in whole seconds, so that its sums are exact.
        """
        self._ahead("_trip_facts")
        self._ahead("spans", "agency_services")
        hours = self.spans.groupBy(*AGENCY_SERVICE).agg(
            F.sum("seconds").alias("seconds"),
            F.min("first_sec").alias("first_sec"),
            F.max("last_sec").alias("last_sec"),
        )
        # A service without timed trips adds nothing on a day it runs.
        return self.agency_services.join(hours, AGENCY_SERVICE, "left").fillna(0, ["seconds"])

    @cached_property
    def service_totals(self) -> DataFrame:
        """Trips, seconds, kilometres, first and last time per agency and service."""
        self._ahead("_trip_facts")
        self._ahead("spans", "segments", "agency_services")
        km = self.segments.groupBy(*AGENCY_SERVICE).agg(F.sum("km").alias("km"))
        totals = self.service_hours.join(km, AGENCY_SERVICE, "left").fillna(0.0, ["km"])
        return self.workspace.keep(totals, "service_totals")

    def running_services(self) -> DataFrame:
        """Services of an agency that run at all, with their active days."""
        return self.agency_services.join(self.service_days, cal.SERVICE)

    def join_service_calendar(self) -> DataFrame:
        """Totals per agency and service next to the active days of the service."""
        return self.service_totals.join(self.service_days, cal.SERVICE)

    # -- days -----------------------------------------------------------------

    def day_sets(self) -> DataFrame:
        """Set of active services per agency and day."""
        days = self.running_services().select(*AGENCY_SERVICE, F.explode("days").alias("day"))
        return days.groupBy(*AGENCY, "day").agg(*_service_set())

    def agencies(self) -> DataFrame:
        """Agencies with at least one bus route."""
        return self.bus_routes.select(*AGENCY).distinct()

    def daily_service(self) -> DataFrame:
        """Every agency on every day of its window; days without service are 0.

        The window of an agency is one more row of it that adds nothing on all its days. Rows are dealt by agency while
        their days are arrays, so that days are made and counted without a shuffle of theirs.
        """
        self._ahead("service_totals", "service_days")
        none = [F.lit(0).cast("bigint").alias("trips"), F.lit(0).cast("bigint").alias("seconds"), F.lit(0.0).alias("km")]
        spine = self.agencies().join(self.window, A).where("window_start IS NOT NULL").select(
            *AGENCY, *none, F.sequence("window_start", "window_end").alias("days")
        )
        both = spine.unionByName(self.join_service_calendar().select(*AGENCY, "trips", "seconds", "km", "days"))
        return dealt(both, *AGENCY).select("*", F.explode("days").alias("day")).groupBy(*AGENCY, "day").agg(
            F.sum("trips").alias("trips"), F.sum("km").alias("km"), (F.sum("seconds") / 3600).alias("hours")
        )

    def weekday_weekend_avg(self) -> DataFrame:
        """Averages over the weekdays and weekend days of the window.

        Zero days count in the divisor, which follows from the window alone,
        so the zero rows themselves are never made. No day is made at all: a
        service adds its totals times its days, and the days on which any
        service runs are bits of a few words.
        """
        self._ahead("_trip_facts")
        self._ahead("spans", "segments", "agency_services")
        self._ahead("service_totals", "service_days")
        words = [f"_w{i}" for i in range(cal.WORDS)]
        running = self.service_days.select(
            *cal.SERVICE,
            F.size(F.filter("days", lambda d: ~cal.is_weekend(d))).alias("weekday_n"),
            F.size(F.filter("days", cal.is_weekend)).alias("weekend_n"),
            *[c.alias(w) for w, c in zip(words, cal.day_words(F.col("days")))],
        )

        def bits(mask: int) -> Column:
            return sum((F.bit_count(F.bit_or(w).bitwiseAND(F.lit(mask))) for w in words), F.lit(0)).cast("bigint")

        weekends = (1 << 7 * cal.WORD_WEEKS) - 1 - cal.WORD_WEEKDAYS
        sums = self.service_totals.join(running, cal.SERVICE).groupBy(*AGENCY).agg(
            F.min("first_sec").alias("first_sec"),
            F.max("last_sec").alias("last_sec"),
            bits(cal.WORD_WEEKDAYS).alias("weekday_operating_days_in_window"),
            bits(weekends).alias("weekend_operating_days_in_window"),
            *[
                F.sum(F.col(m) * F.col(f"{kind}_n")).alias(f"{kind}_{m}")
                for kind in ("weekday", "weekend")
                for m in ("trips", "seconds", "km")
            ],
        ).withColumn(
            "operating_days_in_window",
            F.col("weekday_operating_days_in_window") + F.col("weekend_operating_days_in_window"),
        )
        days = F.sequence("window_start", "window_end")
        lengths = self.window.select(
            *A, "window_start", "window_end", "has_calendar",
            F.size(F.filter(days, lambda d: F.weekday(d) < 5)).alias("weekday_days"),
            F.size(F.filter(days, lambda d: F.weekday(d) >= 5)).alias("weekend_days"),
        )
        known = F.col("window_start").isNotNull()

        def average(kind: str, metric: str, unit: int = 1) -> Column:
            total = F.coalesce(F.col(f"{kind}_{metric}").cast("double"), F.lit(0.0))
            return F.when(known, F.try_divide(total, (F.col(f"{kind}_days") * unit).cast("double")))

        op_days = [f"{k}operating_days_in_window" for k in ("", "weekday_", "weekend_")]
        return self.agencies().join(lengths, A).join(sums, AGENCY, "left").fillna(0, op_days).select(
            *AGENCY, "window_start", "window_end", "has_calendar", "first_sec", "last_sec", *op_days,
            *[
                average(kind, metric, unit).alias(f"{kind}_{name}_avg")
                for kind in ("weekday", "weekend")
                for name, metric, unit in (("trips", "trips", 1), ("hours", "seconds", 3600), ("km", "km", 1))
            ],
        )

    def first_last_service_time(self) -> DataFrame:
        """Earliest first and latest last time of services that run at all; no distances are needed for it."""
        times = self.service_totals if "service_totals" in self.__dict__ else self.service_hours
        return times.join(self.service_days, cal.SERVICE, "left_semi").groupBy(*AGENCY).agg(
            F.min("first_sec").alias("first_sec"), F.max("last_sec").alias("last_sec")
        )

    # -- headway --------------------------------------------------------------

    def departures(self) -> DataFrame:
        """Distinct start times per agency, service and route."""
        keys = [*AGENCY_SERVICE, "route_id"]
        times = self.spans.select(*keys, F.col("first_sec").alias("sec"))
        if "departure_time" in self.bus_trips.columns:
            own = self.bus_trips.select(*keys, gtfs_seconds(F.col("departure_time")).alias("sec"))
            times = times.unionByName(own.where("sec IS NOT NULL"))
        return times.distinct()

    def day_types(self) -> DataFrame:
        """One day of each set of active services of an archive, and how many days have that set."""
        days = self.service_days.select(*cal.SERVICE, F.explode("days").alias("day"))
        return days.groupBy(*A, "day").agg(*_service_set()).groupBy(*A, "n", "x1", "x2").agg(
            F.min("day").alias("sample_day"), F.count("*").alias("n_days")
        ).select(*A, "sample_day", "n_days")

    def route_headway(self) -> DataFrame:
        """Mean gap in minutes over all route-days with at least two start times.

        Days with the same set of active services in the archive have the same gaps on every route, so that each such day
        type is computed on one of its days and weighted by its days. Start times of a route with the same services
        behave alike on all days: their number, first and last one are enough, and only these few rows are repeated, once
        per day type on which one of their services runs. Rows are dealt by route before they are repeated.
        """
        route = [*AGENCY, "route_id"]
        sets = dealt(self.departures(), *route).groupBy(*route, "sec").agg(
            # Services that start on one route at one time.
            F.array_sort(F.collect_set("service_id")).alias("services")
        ).groupBy(*route, "services").agg(
            F.count("*").alias("n"), F.min("sec").alias("lo"), F.max("sec").alias("hi")
        )
        sets = self.workspace.keep(sets, "departure_sets")
        active = self.service_days.select(*cal.SERVICE, F.explode("days").alias("sample_day")).join(
            self.day_types(), [*A, "sample_day"]
        )
        # A set has at most one entry per day of the window.
        of_sets = sets.select(*A, "services").distinct().select("*", F.explode("services").alias("service_id")).join(
            active, cal.SERVICE
        ).groupBy(*A, "services").agg(F.collect_set(F.struct("sample_day", "n_days")).alias("types"))
        of_sets = self.workspace.keep(of_sets, "departure_days")
        # Mean of the gaps between distinct sorted times: (max - min) / (n - 1).
        per_route = dealt(sets, *route).join(of_sets, [*A, "services"]).select(
            *route, "n", "lo", "hi", F.explode("types").alias("_type")
        ).groupBy(*route, F.col("_type.sample_day").alias("sample_day")).agg(
            F.sum("n").alias("n"),
            F.min("lo").alias("lo"),
            F.max("hi").alias("hi"),
            F.first("_type.n_days").alias("n_days"),
        ).where("n >= 2")
        gap = (F.col("hi") - F.col("lo")) / (F.col("n") - 1) / 60
        return per_route.groupBy(*AGENCY).agg(
            (F.sum(gap * F.col("n_days")) / F.sum("n_days")).alias("mean_headway_min"),
            F.sum("n_days").alias("route_days"),
        )

    # -- results --------------------------------------------------------------

    def agency_metrics(self, feeds: DataFrame, unicode_forms: bool = True) -> DataFrame:
        """Final record per named agency.

        ``feeds`` is one row per feed: organization_id, feed_id, publisher_name,
        feed_name, feed_pref_id.
        """
        archives = self.timetable.archives
        extra = [c for c in archives.columns if c not in A]
        self._ahead("_trip_facts")
        self._ahead("spans", "segments", "agency_services")
        self._ahead("service_totals", "service_days")
        # One row per agency each: they are made side by side, and what follows is a join of small tables.
        keep = self.workspace.keep
        counts, averages, headway = self.workspace.together(
            lambda: keep(self.agency_static_counts(), "agency_counts"),
            lambda: keep(self.weekday_weekend_avg(), "agency_averages"),
            lambda: keep(self.route_headway(), "agency_headway"),
        )
        joined = (
            counts
            .join(self.agency_names.where(strip(F.col("agency_name")) != ""), AGENCY)
            .join(averages, AGENCY)
            .join(headway, AGENCY, "left")
            .join(archives.select(*A, *extra), A)
            .join(feeds, ["organization_id", "feed_id"], "left")
        )
        key = canonical_operator(
            F.col("agency_name"), F.coalesce("agency_url", F.lit("")), F.col("prefecture"),
            F.col("organization_id"), unicode_forms,
        )
        dated = F.col("window_start").isNotNull() & F.col("has_calendar")
        return joined.withColumn("prefecture", prefecture_name(F.col("feed_pref_id"))).withColumn(
            "operator_identity_key", key
        ).select(
            operator_id(F.col("operator_identity_key")).alias("operator_id"),
            "operator_identity_key", "agency_name", "agency_id", "agency_url", "publisher_name",
            "organization_id", "feed_id", "feed_name", "prefecture",
            "route_count", "trip_count", "stop_count", "service_id_count", "route_types",
            "version_selector", "operating_days_in_window", "weekday_operating_days_in_window",
            "weekend_operating_days_in_window",
            F.round("weekday_trips_avg", 3).alias("weekday_trips_per_day_avg"),
            F.round("weekend_trips_avg", 3).alias("weekend_trips_per_day_avg"),
            F.round("weekday_hours_avg", 3).alias("weekday_trip_hours_per_day_approx"),
            F.round("weekend_hours_avg", 3).alias("weekend_trip_hours_per_day_approx"),
            F.round("weekday_km_avg", 3).alias("weekday_km_per_day_straight_line_approx"),
            F.round("weekend_km_avg", 3).alias("weekend_km_per_day_straight_line_approx"),
            fmt_time(F.col("first_sec")).alias("first_departure"),
            fmt_time(F.col("last_sec")).alias("last_arrival"),
            F.round("mean_headway_min", 2).alias("mean_route_headway_min_approx"),
            F.col("window_start").alias("schedule_window_start"),
            F.col("window_end").alias("schedule_window_end"),
            F.when(dated, "dated_calendar_applied").otherwise("missing_calendar_or_validity")
            .alias("schedule_status"),
            "source_ix", *extra,
        )

    def feed_summary(self, agency_metrics: DataFrame) -> DataFrame:
        """Per archive: named bus agencies, bus routes, outcome."""
        t = self.timetable
        named = agency_metrics.groupBy(*A).agg(F.count("*").alias("bus_agency_count"))
        return rt.feed_outcome(t.archives, t.agency, t.routes).join(named, A, "left").select(
            *A, F.coalesce("bus_agency_count", F.lit(0)).alias("bus_agency_count"),
            "bus_route_count", "agency_count", "status",
        )


def feed_metrics(summary: DataFrame, archives: DataFrame, feeds: DataFrame) -> DataFrame:
    """Outcome per archive with the feed's names and the file it was read from."""
    named = feeds.select(
        "organization_id", "feed_id", "publisher_name", "feed_name", prefecture_name(F.col("feed_pref_id")).alias("prefecture"))
    return summary.join(archives.select(*A, "source_zip", "source_zip_sha256"), A).join(named, ["organization_id", "feed_id"], "left")


def operator_rollup(agency_metrics: DataFrame) -> DataFrame:
    """Agency records that share an identity key, over all feeds.

    A metric is NULL when no component has a value. The joined lists are cells
    of the result; jobs that need the components use
    :func:`operator_component_feeds`, one row per component.
    """
    order = F.struct("organization_id", "feed_id", "version_selector", "source_ix", "agency_id")

    def joined(column: str | Column) -> Column:
        return F.array_join(F.array_sort(F.collect_set(column)), "|")

    types = F.array_join(
        F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.split("route_types", "\\|"))))), "|"
    )
    sums = {
        "weekday_trips_per_day_sum_approx": "weekday_trips_per_day_avg",
        "weekend_trips_per_day_sum_approx": "weekend_trips_per_day_avg",
        "weekday_trip_hours_sum_approx": "weekday_trip_hours_per_day_approx",
        "weekend_trip_hours_sum_approx": "weekend_trip_hours_per_day_approx",
        "weekday_km_sum_approx": "weekday_km_per_day_straight_line_approx",
        "weekend_km_sum_approx": "weekend_km_per_day_straight_line_approx",
    }
    pair = F.concat_ws("/", "organization_id", "feed_id")
    return agency_metrics.groupBy("operator_id", "operator_identity_key").agg(
        F.min_by(F.struct("agency_name", "agency_url"), order).alias("_first"),
        joined("prefecture").alias("prefectures"),
        joined("publisher_name").alias("publisher_names"),
        joined("feed_id").alias("feed_ids"),
        joined(pair).alias("organization_feed_pairs"),
        joined("agency_id").alias("agency_ids"),
        F.count_distinct("feed_id").alias("feed_count"),
        F.count_distinct(pair).alias("feed_pair_count"),
        F.count("*").alias("agency_record_count"),
        F.sum("route_count").alias("routes_sum_across_feeds"),
        F.sum("trip_count").alias("trips_sum_across_feeds"),
        F.sum("stop_count").alias("stops_sum_across_feeds"),
        F.sum("service_id_count").alias("service_id_sum_across_feeds"),
        types.alias("route_types"),
        *[F.round(F.sum(source), 3).alias(target) for target, source in sums.items()],
        F.bool_and(F.col("schedule_status") == "dated_calendar_applied").alias(
            "schedule_status_all_dated"
        ),
    ).select("*", "_first.agency_name", "_first.agency_url").drop("_first")


def operator_component_feeds(agency_metrics: DataFrame) -> DataFrame:
    """Feed pairs of an operator, one row each."""
    return agency_metrics.select("operator_id", "organization_id", "feed_id").distinct()


__all__ = [
    "ServiceModel", "Timetable", "feed_metrics", "operator_component_feeds", "operator_rollup",
]
