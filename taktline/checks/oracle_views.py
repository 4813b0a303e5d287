"""The derived views once more, in the SQL of the checking engine."""

from __future__ import annotations

# name -> (views it needs, text)
VIEWS: dict[str, tuple[tuple[str, ...], str]] = {}


def view(name: str, needs: str, body: str) -> None:
    VIEWS[name] = (tuple(needs.split()), body.strip())


def compose(needs: str, body: str, replaced: dict[str, str] | None = None) -> str:
    """``body`` behind a WITH list of everything it needs.

    ``replaced`` gives other texts for some of the views.
    """
    texts = {name: text for name, (_, text) in VIEWS.items()} | (replaced or {})
    ordered: list[str] = []

    def add(name: str) -> None:
        if name not in ordered:
            for other in VIEWS[name][0]:
                add(other)
            ordered.append(name)

    for name in needs.split():
        add(name)
    parts = ",\n".join(f"{n} AS (\n{texts[n].strip()}\n)" for n in ordered)
    kind = "WITH RECURSIVE" if "segments" in ordered else "WITH"
    return f"{kind} {parts}\n{body.strip()}"


K = "organization_id, feed_id, version_selector"
TIMES = "first(t ORDER BY stop_sequence, row_ix) FILTER (WHERE t IS NOT NULL)"

view("archives", "", """
SELECT 'org' || n_regionkey AS organization_id, 'feed' || n_nationkey AS feed_id,
       'current' AS version_selector,
       DATE '1997-10-01' + CAST(n_nationkey * 20 AS INTEGER) AS anchor_date,
       'archives/feed' || n_nationkey || '.zip' AS source_zip,
       sha256('feed' || n_nationkey) AS source_zip_sha256
FROM nation
""")
view("feeds", "", """
SELECT 'org' || n_regionkey AS organization_id, 'feed' || n_nationkey AS feed_id,
       'Publisher ' || n_regionkey AS publisher_name, 'Feed ' || n_nationkey AS feed_name,
       n_nationkey + 1 AS feed_pref_id
FROM nation
""")
view("supplier_feed", "", """
SELECT s_suppkey, 'org' || n_regionkey AS organization_id, 'feed' || s_nationkey AS feed_id,
       'current' AS version_selector
FROM supplier JOIN nation ON s_nationkey = n_nationkey
""")
view("agency", "supplier_feed", f"""
SELECT {K},
       CASE WHEN s_suppkey % 9 = 4 THEN '' ELSE 'a' || s_suppkey END AS agency_id,
       CASE WHEN s_suppkey % 40 = 38 THEN 'QWERTYUIOP'
            WHEN s_suppkey % 4 = 0 THEN '株式会社バス' || (s_suppkey % 40)
            WHEN s_suppkey % 4 = 1 THEN 'バス' || (s_suppkey % 40) || '(株)'
            WHEN s_suppkey % 4 = 2 THEN 'バス ' || (s_suppkey % 40) || ' '
            ELSE 'バス' || (s_suppkey % 40) END AS agency_name,
       CASE WHEN s_suppkey % 5 = 0 THEN ''
            ELSE 'https://www.op' || (s_suppkey % 20) || '.example.jp/' END AS agency_url,
       s_suppkey AS row_ix
FROM supplier_feed
""")
view("routes", "supplier_feed", f"""
SELECT {K}, 'r' || p_partkey AS route_id,
       CASE WHEN p_partkey % 10 = 7 OR s_suppkey % 9 = 4 THEN '' ELSE 'a' || s_suppkey END AS agency_id,
       CASE p_size % 5 WHEN 0 THEN '3' WHEN 1 THEN '11' WHEN 2 THEN '715' WHEN 3 THEN '2'
            ELSE 'x' END AS route_type,
       p_partkey AS row_ix
FROM part JOIN supplier_feed ON s_suppkey = p_partkey % (SELECT count(*) FROM supplier)
""")
view("trips", "supplier_feed", f"""
SELECT {K}, 't' || o_orderkey AS trip_id,
       'r' || (o_orderkey % (SELECT count(*) FROM part)) AS route_id,
       's' || (o_custkey % 12) AS service_id, o_orderkey AS row_ix
FROM orders JOIN supplier_feed
  ON s_suppkey = (o_orderkey % (SELECT count(*) FROM part)) % (SELECT count(*) FROM supplier)
""")
view("stop_times", "supplier_feed", f"""
SELECT {K}, trip_id, stop_id, stop_sequence, arrival_sec, departure_sec,
       coalesce(arrival_sec, departure_sec) AS t, row_ix
FROM (
  SELECT {K}, 't' || l_orderkey AS trip_id, 'st' || l_partkey AS stop_id,
         l_linenumber AS stop_sequence,
         CASE WHEN l_returnflag <> 'R'
              THEN 18000 + (l_orderkey * 137) % 57600 + l_linenumber * 180 END AS arrival_sec,
         CASE WHEN NOT (l_returnflag = 'N' AND l_linestatus = 'F')
              THEN 18000 + (l_orderkey * 137) % 57600 + l_linenumber * 180 + 30 END AS departure_sec,
         (l_partkey * 100000 + l_suppkey) * 100 + CAST(floor(l_quantity) AS BIGINT) AS row_ix
  FROM lineitem JOIN supplier_feed
    ON s_suppkey = (l_orderkey % (SELECT count(*) FROM part)) % (SELECT count(*) FROM supplier)
)
""")
view("stops", "stop_times", f"""
SELECT {K}, stop_id,
       CASE WHEN n % 97 <> 0 THEN 33.0::DOUBLE + ((n * 7919) % 10000)::DOUBLE / 10000 END AS stop_lat,
       CASE WHEN n % 97 <> 0 THEN 132.0::DOUBLE + ((n * 104729) % 10000)::DOUBLE / 10000 END AS stop_lon
FROM (SELECT DISTINCT {K}, stop_id, CAST(substr(stop_id, 3) AS BIGINT) AS n FROM stop_times)
""")
view("calendar", "", f"""
SELECT 'org' || n_regionkey AS organization_id, 'feed' || n_nationkey AS feed_id,
       'current' AS version_selector, 's' || k AS service_id,
       DATE '1998-01-01' + CAST(17 * k AS INTEGER) AS start_date,
       DATE '1998-01-01' + CAST(200 + 27 * k AS INTEGER) AS end_date,
       k % 3 <> 2 AS on_week, k % 3 <> 0 AS on_weekend
FROM nation, range(12) r(k)
""")
view("calendar_dates", "", """
SELECT 'org' || n_regionkey AS organization_id, 'feed' || n_nationkey AS feed_id,
       'current' AS version_selector, 's' || (c_custkey % 14) AS service_id,
       DATE '1998-01-01' + CAST(8 * ((31 * c_custkey) % 60) AS INTEGER) AS date,
       CASE WHEN c_custkey % 11 = 0 THEN 3 WHEN c_custkey % 13 < 7 THEN 1 ELSE 2 END AS exception_type,
       c_custkey AS row_ix
FROM customer JOIN nation ON n_nationkey = c_custkey % 25
""")
view("feed_info", "", """
SELECT 'org' || n_regionkey AS organization_id, 'feed' || n_nationkey AS feed_id,
       'current' AS version_selector,
       CASE WHEN n_nationkey % 4 <> 0 THEN DATE '1997-12-20' + CAST(n_nationkey AS INTEGER) END AS feed_start_date,
       CASE WHEN n_nationkey % 6 <> 0 THEN DATE '1999-06-01' END AS feed_end_date
FROM nation
""")

# -- steps of the service metrics, written row by row and day by day ----------

view("only_agency", "agency", f"""
SELECT {K}, count(*) AS agency_rows,
       CASE WHEN count(*) = 1 AND min(agency_id) = '' THEN '__single__'
            WHEN count(DISTINCT agency_id) = 1 THEN min(agency_id) END AS only_agency_id
FROM agency GROUP BY {K}
""")
view("agency_filled", "agency only_agency", f"""
SELECT {K}, CASE WHEN agency_id = '' AND agency_rows = 1 THEN only_agency_id ELSE agency_id END AS agency_id,
       agency_name, agency_url, row_ix
FROM agency JOIN only_agency USING ({K})
""")
view("agency_names", "agency_filled", f"""
SELECT {K}, agency_id, agency_name, agency_url FROM agency_filled
QUALIFY row_number() OVER (PARTITION BY {K}, agency_id ORDER BY row_ix DESC) = 1
""")
view("bus_routes", "routes only_agency", f"""
SELECT {K}, route_id, CASE WHEN agency_id <> '' THEN agency_id ELSE coalesce(only_agency_id, '') END AS agency_id,
       route_type, row_ix
FROM routes JOIN only_agency USING ({K})
WHERE TRY_CAST(route_type AS INTEGER) IN (3, 11) OR TRY_CAST(route_type AS INTEGER) BETWEEN 700 AND 799
""")
view("bus_trips", "trips bus_routes", f"""
SELECT {K}, trip_id, route_id, service_id, agency_id
FROM trips JOIN (SELECT {K}, route_id, agency_id FROM bus_routes) USING ({K}, route_id)
""")
view("bus_stop_times", "stop_times bus_trips", f"""
SELECT {K}, trip_id, stop_id, stop_sequence, t, row_ix, agency_id, service_id, route_id
FROM stop_times JOIN bus_trips USING ({K}, trip_id)
""")
view("spans", "bus_stop_times", f"""
SELECT {K}, trip_id, agency_id, service_id, route_id, first_sec, last_sec,
       greatest(0, last_sec - first_sec) AS seconds
FROM (SELECT {K}, trip_id, agency_id, service_id, route_id,
             first(t ORDER BY stop_sequence, row_ix) FILTER (WHERE t IS NOT NULL) AS first_sec,
             last(t ORDER BY stop_sequence, row_ix) FILTER (WHERE t IS NOT NULL) AS last_sec
      FROM bus_stop_times GROUP BY ALL)
WHERE first_sec IS NOT NULL
""")
view("pairs", "stop_times", f"""
SELECT * FROM (
  SELECT {K}, trip_id, stop_id AS to_stop,
         lag(stop_id) OVER (PARTITION BY {K}, trip_id ORDER BY stop_sequence, row_ix) AS from_stop
  FROM stop_times)
WHERE from_stop IS NOT NULL
""")
view("pair_km", "pairs stops", f"""
SELECT p.*, 6371.0088 * 2 * asin(least(1.0, sqrt(
         power(sin((radians(b.stop_lat) - radians(a.stop_lat)) / 2), 2)
         + cos(radians(a.stop_lat)) * cos(radians(b.stop_lat))
         * power(sin((radians(b.stop_lon) - radians(a.stop_lon)) / 2), 2)))) AS km
FROM pairs p
JOIN stops a ON (a.organization_id, a.feed_id, a.version_selector, a.stop_id)
  = (p.organization_id, p.feed_id, p.version_selector, p.from_stop)
JOIN stops b ON (b.organization_id, b.feed_id, b.version_selector, b.stop_id)
  = (p.organization_id, p.feed_id, p.version_selector, p.to_stop)
WHERE a.stop_lat IS NOT NULL AND b.stop_lat IS NOT NULL
""")
view("trip_km", "pair_km", f"""
SELECT {K}, trip_id, sum(km) AS km, count(*) AS valid_segments FROM pair_km GROUP BY ALL
""")
view("service_totals", "bus_trips spans trip_km", f"""
SELECT {K}, agency_id, service_id, count(*) AS trips, coalesce(sum(seconds), 0) AS seconds,
       coalesce(sum(seconds), 0) / 3600.0::DOUBLE AS hours,
       coalesce(sum(km), 0) AS km, min(first_sec) AS first_sec, max(last_sec) AS last_sec
FROM bus_trips
LEFT JOIN (SELECT {K}, trip_id, seconds, first_sec, last_sec FROM spans) USING ({K}, trip_id)
LEFT JOIN (SELECT {K}, trip_id, km FROM trip_km) USING ({K}, trip_id)
GROUP BY {K}, agency_id, service_id
""")
view("used_services", "bus_trips", f"SELECT DISTINCT {K}, service_id FROM bus_trips")
view("valid_exceptions", "calendar_dates used_services", f"""
SELECT * FROM calendar_dates SEMI JOIN used_services USING ({K}, service_id)
WHERE exception_type IN (1, 2)
""")
view("windows", "archives calendar valid_exceptions feed_info used_services", f"""
SELECT {K}, CASE WHEN ws <= we THEN ws END AS window_start, CASE WHEN ws <= we THEN we END AS window_end,
       has_calendar
FROM (
  SELECT {K}, CASE WHEN min(d) IS NOT NULL THEN greatest(anchor_date - 365, min(d)) END AS ws,
         CASE WHEN max(d) IS NOT NULL THEN least(anchor_date + 365, max(d)) END AS we,
         coalesce(bool_or(dated), false) AS has_calendar
  FROM archives LEFT JOIN (
    SELECT {K}, start_date AS d, true AS dated FROM calendar SEMI JOIN used_services USING ({K}, service_id)
    UNION ALL
    SELECT {K}, end_date, true FROM calendar SEMI JOIN used_services USING ({K}, service_id)
    UNION ALL SELECT {K}, date, true FROM valid_exceptions
    UNION ALL SELECT {K}, feed_start_date, false FROM feed_info
    UNION ALL SELECT {K}, feed_end_date, false FROM feed_info
  ) USING ({K})
  GROUP BY {K}, anchor_date)
""")
view("window_days", "windows", f"""
SELECT {K}, CAST(unnest(generate_series(window_start, window_end, INTERVAL 1 DAY)) AS DATE) AS day
FROM windows WHERE window_start IS NOT NULL
""")
view("regular", "calendar used_services window_days", f"""
SELECT {K}, service_id, day
FROM (SELECT * FROM calendar SEMI JOIN used_services USING ({K}, service_id))
JOIN window_days USING ({K})
WHERE day BETWEEN start_date AND end_date
  AND CASE WHEN isodow(day) < 6 THEN on_week ELSE on_weekend END
""")
view("last_exceptions", "valid_exceptions window_days", f"""
SELECT {K}, service_id, date AS day, exception_type
FROM valid_exceptions SEMI JOIN window_days
  ON (valid_exceptions.organization_id, valid_exceptions.feed_id, valid_exceptions.version_selector, valid_exceptions.date)
   = (window_days.organization_id, window_days.feed_id, window_days.version_selector, window_days.day)
QUALIFY row_number() OVER (PARTITION BY {K}, service_id, date ORDER BY row_ix DESC) = 1
""")
view("active", "regular last_exceptions", f"""
SELECT {K}, service_id, day FROM regular
ANTI JOIN (SELECT * FROM last_exceptions WHERE exception_type = 2) USING ({K}, service_id, day)
UNION
SELECT {K}, service_id, day FROM last_exceptions WHERE exception_type = 1
""")
view("daily", "bus_routes window_days active service_totals", f"""
SELECT {K}, agency_id, day, coalesce(trips, 0) AS trips, coalesce(seconds, 0) AS seconds,
       coalesce(seconds, 0) / 3600.0::DOUBLE AS hours, coalesce(km, 0) AS km
FROM (SELECT DISTINCT {K}, agency_id FROM bus_routes) JOIN window_days USING ({K})
LEFT JOIN (SELECT {K}, agency_id, day, CAST(sum(trips) AS BIGINT) AS trips, sum(seconds) AS seconds, sum(km) AS km
           FROM active JOIN service_totals USING ({K}, service_id) GROUP BY ALL) USING ({K}, agency_id, day)
""")
view("averages", "bus_routes windows daily", f"""
SELECT {K}, agency_id, window_start, window_end, has_calendar,
       count(*) FILTER (trips > 0) AS operating_days_in_window,
       count(*) FILTER (trips > 0 AND isodow(day) < 6) AS weekday_operating_days_in_window,
       count(*) FILTER (trips > 0 AND isodow(day) >= 6) AS weekend_operating_days_in_window,
       avg(trips) FILTER (isodow(day) < 6) AS weekday_trips_avg,
       sum(seconds) FILTER (isodow(day) < 6) / (count(*) FILTER (isodow(day) < 6) * 3600.0::DOUBLE) AS weekday_hours_avg,
       avg(km) FILTER (isodow(day) < 6) AS weekday_km_avg,
       avg(trips) FILTER (isodow(day) >= 6) AS weekend_trips_avg,
       sum(seconds) FILTER (isodow(day) >= 6) / (count(*) FILTER (isodow(day) >= 6) * 3600.0::DOUBLE) AS weekend_hours_avg,
       avg(km) FILTER (isodow(day) >= 6) AS weekend_km_avg
FROM (SELECT DISTINCT {K}, agency_id FROM bus_routes) JOIN windows USING ({K})
LEFT JOIN daily USING ({K}, agency_id)
GROUP BY ALL
""")
view("first_last", "active service_totals", f"""
SELECT {K}, agency_id, min(first_sec) AS first_sec, max(last_sec) AS last_sec
FROM service_totals SEMI JOIN active USING ({K}, service_id)
GROUP BY ALL
""")
# Naive on purpose: every day and every start time, gap by gap.
view("headway", "active spans", f"""
SELECT {K}, agency_id, avg(gap) AS mean_headway_min, count(*) AS route_days
FROM (
  SELECT {K}, agency_id, day, route_id, avg(step) AS gap
  FROM (
    SELECT {K}, agency_id, day, route_id,
           (first_sec - lag(first_sec) OVER (PARTITION BY {K}, agency_id, day, route_id ORDER BY first_sec))
             / 60.0::DOUBLE AS step
    FROM (SELECT DISTINCT {K}, agency_id, day, route_id, first_sec
          FROM spans JOIN active USING ({K}, service_id)))
  WHERE step IS NOT NULL GROUP BY ALL)
GROUP BY ALL
""")
view("static_counts", "bus_routes bus_trips bus_stop_times", f"""
SELECT {K}, agency_id, route_count, route_types, source_ix, coalesce(trip_count, 0) AS trip_count,
       coalesce(service_id_count, 0) AS service_id_count, coalesce(stop_count, 0) AS stop_count
FROM (SELECT {K}, agency_id, count(DISTINCT route_id) AS route_count,
             array_to_string([CAST(x AS VARCHAR) for x in list_sort(list_distinct(list(CAST(route_type AS INTEGER))))], '|') AS route_types,
             min(row_ix) AS source_ix
      FROM bus_routes GROUP BY ALL)
LEFT JOIN (SELECT {K}, agency_id, count(*) AS trip_count, count(DISTINCT service_id) AS service_id_count
           FROM bus_trips GROUP BY ALL) USING ({K}, agency_id)
LEFT JOIN (SELECT {K}, agency_id, count(DISTINCT stop_id) AS stop_count
           FROM bus_stop_times GROUP BY ALL) USING ({K}, agency_id)
""")
FORMS = [
    "一般社団法人", "公益社団法人", "公益財団法人", "一般財団法人", "特定非営利活動法人", "社会福祉法人",
    "株式会社", "有限会社", "(株)", "(有)",
]


def sql_name(column: str) -> str:
    """Normal form of names that need no NFKC step."""
    text = f"regexp_replace(coalesce({column}, ''), '\\s+', '', 'g')"
    for form in sorted(FORMS, key=len, reverse=True):
        text = f"replace({text}, '{form}', '')"
    return text


def sql_host(column: str) -> str:
    return (
        f"regexp_replace(lower(regexp_extract(coalesce({column}, ''), "
        f"'^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#]*@)?([^/:?#]+)', 1)), '^www\\.', '')"
    )


from taktline.constants import PREFECTURES  # noqa: E402  (a fixed list)

SQL_PREFECTURES = "[" + ", ".join(f"'{p}'" for p in PREFECTURES) + "]"


def sql_prefecture(column: str) -> str:
    return (
        f"CASE WHEN {column} BETWEEN 1 AND 47 THEN {SQL_PREFECTURES}[{column}] "
        f"WHEN {column} = 99 THEN '全国' ELSE '不明' END"
    )


def sql_time(column: str) -> str:
    return (
        f"CASE WHEN {column} IS NULL THEN '' ELSE lpad(CAST({column} // 3600 AS VARCHAR), 2, '0') || ':' "
        f"|| lpad(CAST(({column} % 3600) // 60 AS VARCHAR), 2, '0') END"
    )


view("agency_keys", "agency_names feeds", f"""
SELECT {K}, agency_id, agency_name, agency_url, publisher_name, feed_name, prefecture,
       {sql_name('agency_name')} || '|' || CASE WHEN {sql_host('agency_url')} <> '' THEN {sql_host('agency_url')}
         ELSE 'publisher:' || organization_id || '|pref:' || prefecture END AS operator_identity_key
FROM agency_names
JOIN (SELECT organization_id, feed_id, publisher_name, feed_name,
             {sql_prefecture('feed_pref_id')} AS prefecture FROM feeds) USING (organization_id, feed_id)
WHERE trim(agency_name) <> ''
""")
view("agency_metrics", "static_counts agency_keys averages first_last headway archives", f"""
SELECT substr(sha256(operator_identity_key), 1, 16) AS operator_id, operator_identity_key,
       agency_name, agency_id, agency_url, publisher_name, organization_id, feed_id, feed_name, prefecture,
       route_count, trip_count, stop_count, service_id_count, route_types, version_selector,
       operating_days_in_window, weekday_operating_days_in_window, weekend_operating_days_in_window,
       round(weekday_trips_avg, 3) AS weekday_trips_per_day_avg,
       round(weekend_trips_avg, 3) AS weekend_trips_per_day_avg,
       round(weekday_hours_avg, 3) AS weekday_trip_hours_per_day_approx,
       round(weekend_hours_avg, 3) AS weekend_trip_hours_per_day_approx,
       round(weekday_km_avg, 3) AS weekday_km_per_day_straight_line_approx,
       round(weekend_km_avg, 3) AS weekend_km_per_day_straight_line_approx,
       {sql_time('first_sec')} AS first_departure, {sql_time('last_sec')} AS last_arrival,
       round(mean_headway_min, 2) AS mean_route_headway_min_approx,
       window_start AS schedule_window_start, window_end AS schedule_window_end,
       CASE WHEN window_start IS NOT NULL AND has_calendar THEN 'dated_calendar_applied'
            ELSE 'missing_calendar_or_validity' END AS schedule_status,
       source_ix, anchor_date, source_zip, source_zip_sha256
FROM static_counts JOIN agency_keys USING ({K}, agency_id) JOIN averages USING ({K}, agency_id)
LEFT JOIN first_last USING ({K}, agency_id) LEFT JOIN headway USING ({K}, agency_id)
JOIN archives USING ({K})
""")
