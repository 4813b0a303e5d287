"""Service metrics over the derived timetable."""

from __future__ import annotations

from pyspark.sql import functions as F

from taktline.checks.oracle_views import K
from taktline.checks.registry import query
from taktline.checks.views import Views
from taktline.operators import calendar as cal, routes as rt, trips as tr
from taktline.operators.service import A, AGENCY, AGENCY_SERVICE, feed_metrics, operator_rollup

AVERAGES = [f"{k}_{m}_avg" for k in ("weekday", "weekend") for m in ("trips", "hours", "km")]


def rounded(df, digits, *columns):
    return df.withColumns({c: F.round(c, digits) for c in columns})


def hours(df):
    return df.withColumn("hours", F.round(F.col("seconds") / 3600, 6)).drop("seconds")


def sql_rounded(digits, *columns):
    return ", ".join(f"round({c}, {digits}) AS {c}" for c in columns)


@query("single_agency_fill", "agency_filled", f"SELECT {K}, agency_id, agency_name, row_ix FROM agency_filled")
def _(v: Views):
    return rt.single_agency_fill(v.agency).select(*A, "agency_id", "agency_name", "row_ix")


@query("bus_routes_only", "bus_routes", f"SELECT {K}, route_id, agency_id, route_type, row_ix FROM bus_routes")
def _(v: Views):
    return v.plans.bus_routes


@query("named_agencies_only", "agency_names bus_routes", f"""
SELECT {K}, agency_id, agency_name FROM agency_names
SEMI JOIN bus_routes USING ({K}, agency_id) WHERE trim(agency_name) <> ''""")
def _(v: Views):
    named = v.plans.agency_names.where(F.trim("agency_name") != "")
    return named.join(v.plans.agencies(), AGENCY, "left_semi").select(*AGENCY, "agency_name")


@query("feed_outcome", "archives agency bus_routes routes", f"""
SELECT {K}, coalesce(agency_count, 0) AS agency_count, coalesce(bus_route_count, 0) AS bus_route_count,
       CASE WHEN agency_count IS NULL THEN 'agency_txt_missing'
            WHEN bus_route_count IS NULL THEN 'no_bus_route_type' ELSE 'bus_feed_analyzed' END AS status
FROM archives
LEFT JOIN (SELECT {K}, count(*) AS agency_count FROM agency GROUP BY ALL) USING ({K})
LEFT JOIN (SELECT {K}, count(DISTINCT route_id) AS bus_route_count FROM routes
           WHERE route_type IN ('3', '11', '715') GROUP BY ALL) USING ({K})""")
def _(v: Views):
    return rt.feed_outcome(v.archives, v.agency, v.routes)


@query("join_trips_routes", "bus_trips", f"SELECT {K}, trip_id, route_id, service_id, agency_id FROM bus_trips")
def _(v: Views):
    return v.plans.bus_trips.drop("row_ix")


@query("join_stoptimes_trips", "bus_stop_times", f"""
SELECT {K}, agency_id, service_id, route_id, count(*) AS stop_time_rows, count(DISTINCT trip_id) AS trips,
       count(t) AS timed_rows
FROM bus_stop_times GROUP BY ALL""")
def _(v: Views):
    joined = tr.join_stoptimes_trips(v.stop_times, v.plans.trip_lookup)
    per_trip = joined.groupBy(*AGENCY_SERVICE, "route_id", "trip_id").agg(
        F.count("*").alias("n"), F.count(F.coalesce("arrival_sec", "departure_sec")).alias("timed")
    )
    return per_trip.groupBy(*AGENCY_SERVICE, "route_id").agg(
        F.sum("n").alias("stop_time_rows"), F.count("*").alias("trips"), F.sum("timed").alias("timed_rows")
    )


@query("agency_static_counts", "static_counts", f"""
SELECT {K}, agency_id, route_count, route_types, source_ix, trip_count, service_id_count, stop_count
FROM static_counts""")
def _(v: Views):
    return v.service.agency_static_counts()


@query("trip_span", "stop_times", f"""
SELECT {K}, trip_id, first_sec, last_sec, round(greatest(0, last_sec - first_sec) / 3600.0::DOUBLE, 6) AS hours
FROM (SELECT {K}, trip_id,
             first(t ORDER BY stop_sequence, row_ix) FILTER (WHERE t IS NOT NULL) AS first_sec,
             last(t ORDER BY stop_sequence, row_ix) FILTER (WHERE t IS NOT NULL) AS last_sec
      FROM stop_times GROUP BY ALL)
WHERE first_sec IS NOT NULL""")
def _(v: Views):
    return hours(tr.trip_span(v.stop_times))


@query("join_segment_coords", "pair_km", f"""
SELECT {K}, trip_id, from_stop, to_stop, round(km, 6) AS km FROM pair_km""")
def _(v: Views):
    return rounded(tr.join_segment_coords(tr.stop_pairs(v.stop_times, workspace=v.workspace), v.stops), 6, "km")


@query("trip_km", "trip_km", f"SELECT {K}, trip_id, round(km, 6) AS km, valid_segments FROM trip_km")
def _(v: Views):
    return rounded(tr.trip_km(v.stop_times, v.stops, workspace=v.workspace), 6, "km")


@query("service_totals", "service_totals", f"""
SELECT {K}, agency_id, service_id, trips, {sql_rounded(6, 'hours', 'km')}, first_sec, last_sec
FROM service_totals""")
def _(v: Views):
    return rounded(hours(v.service.service_totals), 6, "km")


@query("calendar_exception_valid", "valid_exceptions",
       f"SELECT {K}, service_id, date, exception_type, row_ix FROM valid_exceptions")
def _(v: Views):
    return v.plans.exceptions


@query("join_service_calendar", "active service_totals", f"""
SELECT {K}, agency_id, service_id, trips, count(*) AS active_days, min(day) AS first_day, max(day) AS last_day
FROM service_totals JOIN active USING ({K}, service_id) GROUP BY ALL""")
def _(v: Views):
    return v.service.join_service_calendar().select(
        *AGENCY_SERVICE, "trips", F.size("days").cast("bigint").alias("active_days"),
        F.array_min("days").alias("first_day"), F.array_max("days").alias("last_day"),
    )


@query("schedule_window", "windows", f"SELECT {K}, window_start, window_end, has_calendar FROM windows")
def _(v: Views):
    return v.plans.window


@query("calendar_day_range_join", "regular", f"SELECT {K}, service_id, day FROM regular")
def _(v: Views):
    return cal.calendar_day_range_join(v.plans.calendar, v.plans.window)


@query("exception_overlay", "active", f"SELECT {K}, service_id, day FROM active")
def _(v: Views):
    s = v.plans
    return cal.exception_overlay(s.calendar, s.exceptions, s.window)


@query("daily_service", "daily", f"""
SELECT {K}, agency_id, day, trips, {sql_rounded(6, 'hours', 'km')} FROM daily""")
def _(v: Views):
    return rounded(v.service.daily_service(), 6, "hours", "km")


@query("weekday_weekend_avg", "averages", f"""
SELECT {K}, agency_id, window_start, window_end, has_calendar, operating_days_in_window,
       weekday_operating_days_in_window, weekend_operating_days_in_window, {sql_rounded(6, *AVERAGES)}
FROM averages""")
def _(v: Views):
    return rounded(v.service.weekday_weekend_avg().drop("first_sec", "last_sec"), 6, *AVERAGES)


@query("first_last_service_time", "first_last", f"SELECT {K}, agency_id, first_sec, last_sec FROM first_last")
def _(v: Views):
    return v.service.first_last_service_time()


@query("route_headway", "headway", f"""
SELECT {K}, agency_id, round(mean_headway_min, 6) AS mean_headway_min, route_days FROM headway""")
def _(v: Views):
    return rounded(v.service.route_headway(), 6, "mean_headway_min")


@query("agency_metrics", "agency_metrics", "SELECT * FROM agency_metrics")
def _(v: Views):
    return v.agency_metrics


@query("feed_summary", "agency_metrics archives agency routes", f"""
SELECT {K}, coalesce(bus_agency_count, 0) AS bus_agency_count,
       coalesce(bus_route_count, 0) AS bus_route_count, coalesce(agency_count, 0) AS agency_count,
       CASE WHEN agency_count IS NULL THEN 'agency_txt_missing'
            WHEN bus_route_count IS NULL THEN 'no_bus_route_type' ELSE 'bus_feed_analyzed' END AS status
FROM archives
LEFT JOIN (SELECT {K}, count(*) AS agency_count FROM agency GROUP BY ALL) USING ({K})
LEFT JOIN (SELECT {K}, count(DISTINCT route_id) AS bus_route_count FROM routes
           WHERE route_type IN ('3', '11', '715') GROUP BY ALL) USING ({K})
LEFT JOIN (SELECT {K}, count(*) AS bus_agency_count FROM agency_metrics GROUP BY ALL) USING ({K})""")
def _(v: Views):
    return v.service.feed_summary(v.agency_metrics)


@query("feed_metrics", "archives agency feeds", f"""
SELECT {K}, source_zip, source_zip_sha256, publisher_name, feed_name, CASE feed_pref_id WHEN 1 THEN '北海道' WHEN 13 THEN '東京都' ELSE '' END AS known
FROM archives LEFT JOIN feeds USING (organization_id, feed_id)""")
def _(v: Views):
    summary = rt.feed_outcome(v.archives, v.agency, v.routes)
    rows = feed_metrics(summary, v.archives, v.feeds)
    known = F.when(F.col("prefecture").isin("北海道", "東京都"), F.col("prefecture")).otherwise("")
    return rows.select("organization_id", "feed_id", "version_selector", "source_zip", "source_zip_sha256", "publisher_name", "feed_name", known.alias("known"))
