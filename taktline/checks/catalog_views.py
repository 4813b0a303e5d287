"""Catalogue- and history-shaped views that Spark derives from the given tables."""

from __future__ import annotations

import datetime as dt
from functools import cached_property

from pyspark.sql import DataFrame, functions as F

from taktline.checks.oracle_views import view
from taktline.checks.views import Views, text
from taktline.constants import ARCHIVE_KEYS
from taktline.functions import disposition_filename, effective_date, upload_datetime
from taktline.operators import catalog, history
from taktline.operators.ordering import running_number

A = list(ARCHIVE_KEYS)
ANCHOR = dt.date(2020, 6, 25)
# Archive file names state years from 2000 on; the order dates are moved there.
SHIFT_DAYS = 7300


class CatalogViews(Views):
    @cached_property
    def manifest(self) -> DataFrame:
        c, o = F.col("o_custkey"), F.col("o_orderkey")
        months = -(F.year("o_orderdate") * 12 + F.month("o_orderdate"))
        ranked = running_number(
            self.table("orders"), ["o_custkey"], [F.desc("o_orderdate"), F.desc("o_orderkey")], months, "n"
        )
        selector = F.when(F.col("n") == 1, "current").otherwise(text("prev_", F.col("n") - 1))
        day = F.date_format(F.date_add("o_orderdate", SHIFT_DAYS), "yyyyMMdd")
        stamp = F.concat(F.lit('attachment; filename="feed_'), day, F.lit("_"), day, F.lit('120000.zip"; size=1'))
        named = ranked.select(
            text("org", c % 5).alias("organization_id"),
            text("feed", c).alias("feed_id"),
            selector.alias("version_selector"),
            F.when(o % 13 == 0, "404").when(o % 29 == 0, "500").otherwise("200").alias("status"),
            F.concat(F.lit("archives/"), text("feed", c), F.lit("__"), selector, F.lit(".zip")).alias("path"),
            F.floor("o_totalprice").alias("bytes"),
            text("h", F.floor("o_totalprice") % 50).alias("sha256"),
            F.when(o % 17 == 0, "").otherwise(stamp).alias("content_disposition"),
            F.concat(F.lit("https://api.example.jp/"), text("feed", c), F.lit("?rid="), selector).alias("source_url"),
            F.when(o % 101 != 0, F.concat(F.lit("sig"), F.substring("o_orderpriority", 1, 1), "o_orderstatus"))
            .alias("timetable_signature"),
            text("v", o % 3).alias("validity_signature"),
            o.alias("row_ix"),
        )
        file_name = disposition_filename(F.col("content_disposition"), F.col("path"))
        return named.withColumns(
            {"effective_start": effective_date(file_name), "upload_utc": upload_datetime(file_name)}
        )

    @cached_property
    def versions(self) -> DataFrame:
        return catalog.successful_archives(self.manifest)

    @cached_property
    def dated_versions(self) -> DataFrame:
        """Versions with the window they state themselves."""
        length = ((F.col("row_ix") % 4) * 150).cast("int")
        return self.versions.withColumns(
            {"validity_start": F.col("effective_start"), "validity_end": F.date_add("effective_start", length)}
        )

    @cached_property
    def registry(self) -> DataFrame:
        c = F.col("o_custkey")
        start = F.col("start")
        newest = self.table("orders").groupBy("o_custkey").agg(
            F.max(F.struct("o_orderdate", "o_orderkey")).alias("m")
        ).select("o_custkey", F.date_add("m.o_orderdate", SHIFT_DAYS).alias("start"))
        return newest.select(
            text("org", c % 5).alias("organization_id"),
            text("feed", c).alias("feed_id"),
            (c % 50).cast("int").alias("feed_pref_id"),
            start.alias("latest_feed_start_date"),
            F.when(c % 31 != 0, F.date_add(start, ((c % 5) * 200).cast("int"))).alias("latest_feed_end_date"),
            (c % 23 == 0).alias("feed_is_discontinued"),
            F.when(c % 46 != 0, F.date_add(start, 100)).alias("feed_discontinued_date"),
        )

    @cached_property
    def selection(self) -> DataFrame:
        return catalog.anchor_select(self.registry, self.dated_versions, ANCHOR)

    @cached_property
    def coverage(self) -> DataFrame:
        c = F.col("c_custkey")
        return self.table("customer").where(c % 3 != 0).select(
            text("org", c % 5).alias("organization_id"), text("feed", c).alias("feed_id"),
            (c % 12).cast("int").alias("requested_history_depth"),
        )

    @cached_property
    def classified(self) -> DataFrame:
        return history.version_classify(self.versions)

    @cached_property
    def version_metrics(self) -> DataFrame:
        """Two operators per feed: one in every generation, one in some."""
        ix, c = F.col("row_ix"), F.substring("feed_id", 5, 18).cast("bigint")
        trips = F.when(ix % 19 != 0, (F.col("bytes") % 200).cast("double"))
        operators = F.array_compact(
            F.array(text("op", F.floor(c / 2)), F.when(ix % 2 == 0, text("op", c % 7 + 1000000)))
        )
        return self.classified.where(
            "distinct_generation_number IS NOT NULL AND effective_start IS NOT NULL"
        ).select(
            F.explode(operators).alias("operator_id"), *A, "timetable_signature",
            F.col("effective_start").alias("generation_effective_start"),
            trips.alias("weekday_trips_per_day_avg"),
            F.when(ix % 23 != 0, trips / 2).alias("weekday_trip_hours_per_day_approx"),
            (trips * 3).alias("weekday_km_per_day_straight_line_approx"),
        )

    @cached_property
    def component_feeds(self) -> DataFrame:
        return self.version_metrics.select("operator_id", "organization_id", "feed_id").distinct()


KEYS = "organization_id, feed_id, version_selector"
FK = "organization_id, feed_id"

view("manifest", "", """
SELECT 'org' || (o_custkey % 5) AS organization_id, 'feed' || o_custkey AS feed_id, version_selector,
       CASE WHEN o_orderkey % 13 = 0 THEN '404' WHEN o_orderkey % 29 = 0 THEN '500' ELSE '200' END AS status,
       'archives/feed' || o_custkey || '__' || version_selector || '.zip' AS path,
       CAST(floor(o_totalprice) AS BIGINT) AS bytes,
       'h' || (CAST(floor(o_totalprice) AS BIGINT) % 50) AS sha256,
       CASE WHEN o_orderkey % 17 = 0 THEN '' ELSE 'attachment; filename="feed_' || strftime(CAST(o_orderdate AS DATE) + 7300, '%Y%m%d')
            || '_' || strftime(CAST(o_orderdate AS DATE) + 7300, '%Y%m%d') || '120000.zip"; size=1' END AS content_disposition,
       'https://api.example.jp/feed' || o_custkey || '?rid=' || version_selector AS source_url,
       CASE WHEN o_orderkey % 101 <> 0 THEN 'sig' || substr(o_orderpriority, 1, 1) || o_orderstatus END AS timetable_signature,
       'v' || (o_orderkey % 3) AS validity_signature, o_orderkey AS row_ix,
       CASE WHEN o_orderkey % 17 <> 0 THEN CAST(o_orderdate AS DATE) + 7300 END AS effective_start,
       CASE WHEN o_orderkey % 17 <> 0 THEN CAST(CAST(o_orderdate AS DATE) + 7300 AS TIMESTAMP) + INTERVAL 12 HOUR END AS upload_utc,
       selector_no
FROM (SELECT *, CASE WHEN selector_no = 0 THEN 'current' ELSE 'prev_' || selector_no END AS version_selector
      FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) - 1
                   AS selector_no FROM orders))
""")
view("versions", "manifest", "SELECT * FROM manifest WHERE status = '200'")
view("dated_versions", "versions", """
SELECT *, effective_start AS validity_start,
       effective_start + CAST((row_ix % 4) * 150 AS INTEGER) AS validity_end FROM versions
""")
view("registry", "", """
SELECT 'org' || (o_custkey % 5) AS organization_id, 'feed' || o_custkey AS feed_id,
       CAST(o_custkey % 50 AS INTEGER) AS feed_pref_id, start AS latest_feed_start_date,
       CASE WHEN o_custkey % 31 <> 0 THEN start + CAST((o_custkey % 5) * 200 AS INTEGER) END AS latest_feed_end_date,
       o_custkey % 23 = 0 AS feed_is_discontinued,
       CASE WHEN o_custkey % 46 <> 0 THEN start + 100 END AS feed_discontinued_date
FROM (SELECT o_custkey, CAST(max(o_orderdate) AS DATE) + 7300 AS start FROM orders GROUP BY o_custkey)
""")
view("selection", "registry dated_versions", f"""
SELECT {FK}, CASE WHEN excluded IS NULL THEN version_selector END AS selected_version_selector,
       coalesce(excluded, CASE WHEN version_selector IS NOT NULL THEN 'selected'
                ELSE 'no_downloaded_archive_valid_on_anchor' END) AS status,
       latest_feed_start_date AS registry_latest_start, latest_feed_end_date AS registry_latest_end,
       feed_is_discontinued, feed_discontinued_date,
       CASE WHEN excluded IS NULL THEN CASE WHEN own THEN validity_start WHEN version_selector IS NOT NULL THEN latest_feed_start_date END END AS validity_start,
       CASE WHEN excluded IS NULL THEN CASE WHEN own THEN validity_end WHEN version_selector IS NOT NULL THEN latest_feed_end_date END END AS validity_end,
       CASE WHEN excluded IS NULL AND version_selector IS NOT NULL THEN
         CASE WHEN own THEN 'archive_feed_info_window' ELSE 'registry_latest_window_feed_info_missing_or_noncovering' END END AS selection_basis
FROM (
  SELECT r.*, CASE WHEN feed_is_discontinued AND feed_discontinued_date IS NULL THEN 'excluded_discontinued_date_unknown'
                   WHEN feed_is_discontinued AND feed_discontinued_date <= DATE '2020-06-25'
                     THEN 'excluded_discontinued_on_or_before_anchor' END AS excluded,
         v.version_selector, v.validity_start, v.validity_end,
         coalesce(DATE '2020-06-25' BETWEEN v.validity_start AND v.validity_end, false) AS own
  FROM registry r LEFT JOIN dated_versions v
    ON v.organization_id = r.organization_id AND v.feed_id = r.feed_id
   AND (DATE '2020-06-25' BETWEEN v.validity_start AND v.validity_end
        OR (v.version_selector = 'current'
            AND DATE '2020-06-25' BETWEEN r.latest_feed_start_date AND r.latest_feed_end_date))
  QUALIFY row_number() OVER (PARTITION BY r.organization_id, r.feed_id ORDER BY v.selector_no) = 1)
""")
view("coverage", "", """
SELECT 'org' || (c_custkey % 5) AS organization_id, 'feed' || c_custkey AS feed_id,
       CAST(c_custkey % 12 AS INTEGER) AS requested_history_depth
FROM customer WHERE c_custkey % 3 <> 0
""")
view("classified", "versions", f"""
SELECT * EXCLUDE (is_head, head_validity, head_sha),
       CASE WHEN is_head THEN CAST(sum(CAST(is_head AS INTEGER)) OVER (PARTITION BY {FK} ORDER BY selector_no) AS BIGINT) END
         AS distinct_generation_number,
       CASE WHEN timetable_signature IS NULL THEN 'analysis_error'
            WHEN is_head AND sum(CAST(is_head AS INTEGER)) OVER (PARTITION BY {FK} ORDER BY selector_no) = 1 THEN 'latest_distinct_generation'
            WHEN is_head THEN 'timetable_content_changed'
            WHEN validity_signature <> head_validity THEN 'validity_window_only'
            WHEN sha256 <> head_sha THEN 'same_timetable_reupload_or_metadata_only'
            ELSE 'byte_identical_duplicate' END AS classification
FROM (SELECT *, timetable_signature IS NOT NULL
                AND row_number() OVER (PARTITION BY {FK}, timetable_signature ORDER BY selector_no) = 1 AS is_head,
             first_value(validity_signature) OVER (PARTITION BY {FK}, timetable_signature ORDER BY selector_no) AS head_validity,
             first_value(sha256) OVER (PARTITION BY {FK}, timetable_signature ORDER BY selector_no) AS head_sha
      FROM versions)
""")
view("feed_states", "classified", f"""
SELECT *, distinct_timetable_generations >= 2 AS has_2plus_generations,
       coalesce(history_span_days >= 365, false) AS history_1plus_year,
       coalesce(history_span_days >= 730, false) AS history_2plus_year,
       coalesce(history_span_days >= 1095, false) AS history_3plus_year,
       CASE WHEN history_span_days IS NOT NULL THEN 'measured' ELSE 'effective_schedule_date_unavailable' END AS date_evidence_status,
       'measured' AS history_status
FROM (SELECT *, CAST(current_generation_effective_start - oldest_distinct_generation_effective_start AS INTEGER) AS history_span_days,
             CAST(floor(date_diff('second', oldest_distinct_old_upload_utc, latest_upload_utc) / 86400) AS INTEGER) AS archive_publication_span_days
      FROM (SELECT {FK}, count(distinct_generation_number) AS distinct_timetable_generations,
                   count(distinct_generation_number) FILTER (version_selector <> 'current') AS distinct_old_generations,
                   count(*) AS archive_versions_downloaded,
                   max(upload_utc) FILTER (distinct_generation_number IS NOT NULL AND version_selector = 'current') AS latest_upload_utc,
                   min(upload_utc) FILTER (distinct_generation_number IS NOT NULL AND version_selector <> 'current') AS oldest_distinct_old_upload_utc,
                   max(effective_start) FILTER (distinct_generation_number IS NOT NULL AND version_selector = 'current') AS current_generation_effective_start,
                   min(effective_start) FILTER (distinct_generation_number IS NOT NULL AND version_selector <> 'current') AS oldest_distinct_generation_effective_start
            FROM classified GROUP BY ALL))
""")
view("representatives", "classified", f"""
SELECT {FK}, timetable_signature, version_selector, effective_start FROM classified
WHERE timetable_signature IS NOT NULL
QUALIFY row_number() OVER (PARTITION BY {FK}, timetable_signature
  ORDER BY version_selector <> 'current', effective_start IS NULL, effective_start, selector_no) = 1
""")
view("exhaustion", "manifest coverage", f"""
SELECT {FK}, terminal_404, deepest_version, api_error,
       coalesce(requested_history_depth, 0) > 0 AND coalesce(deepest_version, 0) >= coalesce(requested_history_depth, 0)
         AND NOT terminal_404 AS depth_capped
FROM (SELECT {FK}, bool_or(status = '404') AS terminal_404,
             CAST(max(selector_no) FILTER (status = '200') AS INTEGER) AS deepest_version,
             bool_or(status NOT IN ('200', '404')) AS api_error
      FROM manifest WHERE selector_no > 0 GROUP BY ALL)
LEFT JOIN coverage USING ({FK})
""")
view("version_metrics", "classified", f"""
SELECT unnest(CASE WHEN row_ix % 2 = 0 THEN ['op' || (c // 2), 'op' || (c % 7 + 1000000)] ELSE ['op' || (c // 2)] END) AS operator_id,
       {KEYS}, timetable_signature, effective_start AS generation_effective_start,
       CASE WHEN row_ix % 19 <> 0 THEN CAST(bytes % 200 AS DOUBLE) END AS trips,
       CASE WHEN row_ix % 19 <> 0 AND row_ix % 23 <> 0 THEN (bytes % 200) / 2.0::DOUBLE END AS hours,
       CASE WHEN row_ix % 19 <> 0 THEN (bytes % 200) * 3.0::DOUBLE END AS km
FROM (SELECT *, CAST(substr(feed_id, 5) AS BIGINT) AS c FROM classified
      WHERE distinct_generation_number IS NOT NULL AND effective_start IS NOT NULL)
""")
view("component_feeds", "version_metrics", f"SELECT DISTINCT operator_id, {FK} FROM version_metrics")
view("operator_feed_states", "component_feeds version_metrics representatives feed_states exhaustion", f"""
SELECT operator_id, {FK}, coalesce(generations, 0) AS generations, coalesce(current_present, false) AS current_present,
       coalesce(generations = distinct_timetable_generations, false) AS everywhere,
       CAST(latest_start - oldest_start AS INTEGER) AS span,
       coalesce(terminal_404, false) AS terminal_404, coalesce(api_error, false) AS api_error,
       coalesce(depth_capped, false) AS depth_capped
FROM component_feeds
LEFT JOIN (
  SELECT operator_id, {FK}, count(*) AS generations, bool_or(is_current) AS current_present,
         max(effective_start) FILTER (is_current) AS latest_start,
         min(effective_start) FILTER (NOT is_current) AS oldest_start
  FROM (SELECT operator_id, {FK}, timetable_signature, bool_or(version_selector = 'current') AS is_current
        FROM version_metrics GROUP BY ALL)
  LEFT JOIN (SELECT {FK}, timetable_signature, effective_start FROM representatives)
    USING ({FK}, timetable_signature)
  GROUP BY ALL) USING (operator_id, {FK})
LEFT JOIN (SELECT {FK}, distinct_timetable_generations FROM feed_states) USING ({FK})
LEFT JOIN exhaustion USING ({FK})
""")
YEAR_SQL = ",\n".join(
    f"CASE WHEN stable THEN CASE WHEN spans = feeds AND min_span >= {d} THEN true WHEN absence_known THEN false END END "
    f"AS years_{n}plus_all_feeds" for n, d in ((1, 365), (2, 730), (3, 1095))
)
view("operator_history", "operator_feed_states", f"""
SELECT operator_id, feeds AS current_feed_count, all_current AS agency_present_current_in_all_component_feeds,
       stable AS agency_identity_present_in_all_distinct_feed_generations,
       min_gen AS distinct_generations_min_across_feeds,
       CASE WHEN absence_known THEN min_gen = 1 AND max_gen = 1 END AS current_only_all_feeds,
       CASE WHEN stable AND min_gen >= 2 THEN true WHEN absence_known THEN false END AS generations_2plus_all_feeds,
       {YEAR_SQL},
       min_span AS minimum_component_history_span_days, exhausted AS all_component_feeds_history_exhausted,
       capped AS history_depth_cap_reached,
       CASE WHEN api_error THEN 'history_api_error' WHEN capped THEN 'depth_cap_reached'
            WHEN NOT exhausted THEN 'history_exhaustion_unconfirmed'
            WHEN all_current AND NOT stable THEN 'agency_identity_not_stable_across_generations'
            WHEN stable THEN 'measured_same_agency_across_all_feeds'
            ELSE 'current_agency_not_confirmed_in_all_component_feeds' END AS history_status
FROM (SELECT *, all_current AND everywhere AS stable,
             all_current AND everywhere AND exhausted AND NOT api_error AS absence_known
      FROM (SELECT operator_id, count(*) AS feeds, bool_and(current_present) AS all_current,
                   bool_and(everywhere) AS everywhere, min(generations) AS min_gen, max(generations) AS max_gen,
                   count(span) AS spans, min(span) AS min_span, bool_and(terminal_404) AS exhausted,
                   bool_or(depth_capped) AS capped, bool_or(api_error) AS api_error
            FROM operator_feed_states GROUP BY operator_id))
""")
view("yoy_pairs", "version_metrics", f"""
WITH supply AS (
  SELECT operator_id, {FK}, timetable_signature, bool_or(version_selector = 'current') AS is_current,
         min(generation_effective_start) AS effective, sum(trips) AS trips, sum(hours) AS hours, sum(km) AS km
  FROM version_metrics GROUP BY operator_id, {FK}, timetable_signature)
SELECT n.operator_id, n.organization_id, n.feed_id, CAST(n.effective - o.effective AS INTEGER) AS gap_days,
       o.effective AS old_effective, o.trips AS old_trips, o.hours AS old_hours, o.km AS old_km,
       n.effective AS current_effective, n.trips AS current_trips, n.hours AS current_hours, n.km AS current_km
FROM (SELECT * FROM supply WHERE is_current
      QUALIFY row_number() OVER (PARTITION BY operator_id, {FK} ORDER BY effective DESC, timetable_signature DESC) = 1) n
JOIN supply o ON (n.operator_id, n.organization_id, n.feed_id) = (o.operator_id, o.organization_id, o.feed_id)
 AND NOT o.is_current AND n.effective - o.effective BETWEEN 365 AND 455
WHERE n.trips IS NOT NULL AND o.trips IS NOT NULL
QUALIFY row_number() OVER (PARTITION BY n.operator_id, n.organization_id, n.feed_id
  ORDER BY abs(n.effective - o.effective - 365), o.timetable_signature) = 1
""")


def _yoy_sql() -> str:
    out = []
    for m, name in (("trips", "weekday_trips"), ("hours", "weekday_trip_hours"), ("km", "weekday_straight_line_km")):
        out += [
            f"CASE WHEN ok THEN round(old_{m}, 3) END AS {name}_per_day_previous",
            f"CASE WHEN ok THEN round(current_{m}, 3) END AS {name}_per_day_current",
            f"CASE WHEN ok AND old_{m} <> 0 THEN round((current_{m} - old_{m}) / old_{m} * 100, 3) END AS {name}_yoy_pct",
        ]
    return ", ".join(out)


view("supply_yoy", "component_feeds yoy_pairs", f"""
SELECT operator_id, component_feed_count, comparable_component_feed_count, ok AS gtfs_supply_yoy_computable,
       CASE WHEN ok THEN old_lo END AS previous_effective_date_min, CASE WHEN ok THEN old_hi END AS previous_effective_date_max,
       CASE WHEN ok THEN now_lo END AS current_effective_date_min, CASE WHEN ok THEN now_hi END AS current_effective_date_max,
       {_yoy_sql()},
       CASE WHEN ok THEN 'measured_all_component_feeds' ELSE 'not_confirmed_in_downloaded_distinct_history' END AS comparison_status
FROM (SELECT *, component_feed_count = comparable_component_feed_count AND old_hi - old_lo <= 90 AS ok
      FROM (SELECT operator_id, count(*) AS component_feed_count, count(gap_days) AS comparable_component_feed_count,
                   min(old_effective) AS old_lo, max(old_effective) AS old_hi,
                   min(current_effective) AS now_lo, max(current_effective) AS now_hi,
                   sum(old_trips) AS old_trips, sum(current_trips) AS current_trips,
                   CASE WHEN count(old_hours) = count(gap_days) THEN sum(old_hours) END AS old_hours,
                   CASE WHEN count(current_hours) = count(gap_days) THEN sum(current_hours) END AS current_hours,
                   sum(old_km) AS old_km, sum(current_km) AS current_km
            FROM component_feeds LEFT JOIN yoy_pairs USING (operator_id, {FK}) GROUP BY operator_id))
""")
