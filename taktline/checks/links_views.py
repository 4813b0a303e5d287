"""Operator-statistics-shaped views that Spark derives from the given tables."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, functions as F

from taktline.checks.catalog_views import CatalogViews
from taktline.checks.oracle_views import sql_host, sql_name, sql_prefecture, view
from taktline.checks.views import text
from taktline.functions import canonical_operator, operator_id, prefecture_name, short_hash
from taktline.operators import funnel, links
from taktline.operators.matching import Matching
from taktline.operators.service import operator_rollup
from taktline.sources.lists import approved_aliases


class LinksViews(CatalogViews):
    # -- statistics files -----------------------------------------------------

    @cached_property
    def records(self) -> DataFrame:
        c = F.col("c_custkey")
        k = c % 60
        name = (
            F.when(c % 37 == 0, "")
            .when(c % 3 == 0, text("バス", k))
            .when((c % 3 == 1) & (c % 2 == 0), text("㈱バス", k))
            .when(c % 3 == 1, F.concat(text("バス", k), F.lit("株式会社")))
            .otherwise(text("交通", k))
        )
        number = F.when(k % 4 == 0, "").when((k % 7 == 0) | (k == 27), text("N", c % 120)).otherwise(text("N", k))
        cells = {
            "事業者名": name,
            "事業者番号": number,
            "対象年度": F.concat((F.floor(c / 120) % 5 + 2020).cast("string"), F.lit("年度")),
            "事業区分": F.col("c_mktsegment"),
            "住所": text("L", k),
            "輸送人員": F.when(c % 7 == 0, "-").when(c % 10 == 0, "").otherwise(c.cast("string")),
            "車両数": F.when(F.col("c_acctbal") < 0, "").otherwise((c % 90).cast("string")),
            "延実在車両数": F.when(c % 5 == 0, "").otherwise("9"),
            "営業収入": F.when(c % 9 == 0, "N/A").otherwise("1"),
            "運転者数": F.when(c % 6 == 0, "").otherwise("5"),
        }
        every = F.array(*[F.lit(x) for x in cells])
        short = F.array_except(every, F.array(F.lit("対象年度"), F.lit("運転者数")))
        kind = F.when(F.floor(c / 60) % 2 == 0, "yusoujisseki_").otherwise("busreport_")
        mapped = F.create_map(*[x for n, e in cells.items() for x in (F.lit(n), e)])
        return self.spread("customer", "c_custkey").select(
            F.concat(kind, (c % 4).cast("string"), F.lit(".csv")).alias("source_file"),
            c.alias("source_row"),
            F.when(c % 4 == 3, short).otherwise(every).alias("columns"),
            mapped.alias("row"),
        ).withColumn("row", F.map_filter("row", lambda n, _: F.array_contains("columns", n)))

    @cached_property
    def links_rows(self) -> DataFrame:
        return self.workspace.keep(links.links_rows(self.records), "links_rows")

    @cached_property
    def links(self) -> DataFrame:
        return links.links_operator_rollup(self.links_rows).withColumn(
            "row_ix", F.struct("first_path", "first_file", "first_row")
        )

    @cached_property
    def per_permit(self) -> DataFrame:
        return links.transport_complete(self.links_rows)

    # -- operators ------------------------------------------------------------

    @cached_property
    def agency_records(self) -> DataFrame:
        """Agency records with plain numbers in place of the service metrics."""
        s, k = F.col("row_ix"), F.substring("feed_id", 5, 9).cast("int")
        code = F.when(k == 3, 99).when(k == 5, 60).otherwise(k + 14)
        base = self.agency.withColumn("prefecture", prefecture_name(code))
        key = canonical_operator(F.col("agency_name"), F.col("agency_url"), F.col("prefecture"), F.col("organization_id"))
        number = s.cast("double")
        return base.withColumn("operator_identity_key", key).select(
            operator_id(F.col("operator_identity_key")).alias("operator_id"), "operator_identity_key",
            "agency_name", text("a", s).alias("agency_id"), "agency_url",
            F.concat(F.lit("Publisher "), F.col("organization_id")).alias("publisher_name"),
            "organization_id", "feed_id", "version_selector", "prefecture",
            (s % 7 + 1).alias("route_count"), (s % 50).alias("trip_count"), (s % 30).alias("stop_count"),
            (s % 4).alias("service_id_count"), F.when(s % 2 == 0, "3|11").otherwise("3|715").alias("route_types"),
            F.when(s % 6 != 0, number * 1.5).alias("weekday_trips_per_day_avg"),
            F.when(s % 6 != 0, number * 0.5).alias("weekend_trips_per_day_avg"),
            F.when(s % 5 != 0, number).alias("weekday_trip_hours_per_day_approx"),
            F.when(s % 5 != 0, number / 4).alias("weekend_trip_hours_per_day_approx"),
            (number * 3).alias("weekday_km_per_day_straight_line_approx"),
            (number * 2).alias("weekend_km_per_day_straight_line_approx"),
            F.when(s % 7 != 0, "dated_calendar_applied").otherwise("missing_calendar_or_validity").alias("schedule_status"),
            s.alias("source_ix"),
        )

    @cached_property
    def operators(self) -> DataFrame:
        return self.workspace.keep(operator_rollup(self.agency_records), "operators")

    @cached_property
    def _first_record(self) -> DataFrame:
        return self.agency_records.groupBy("operator_id").agg(F.min("source_ix").alias("s"))

    @cached_property
    def history_summary(self) -> DataFrame:
        h = F.col("s") % 4
        return self._first_record.select(
            "operator_id",
            F.when(h < 2, True).when(h == 2, False).alias("years_2plus_all_feeds"),
            F.when(h == 0, True).when(h < 3, False).alias("years_3plus_all_feeds"),
        )

    @cached_property
    def supply(self) -> DataFrame:
        return self._first_record.select("operator_id", (F.col("s") % 5 == 0).alias("gtfs_supply_yoy_computable"))

    @cached_property
    def alias_rows(self) -> DataFrame:
        s = F.col("source_ix")
        return self.agency_records.where(s % 40 == 38).select(
            "operator_id", F.concat(F.lit("L-"), short_hash(F.lit("N9"))).alias("links_operator_id"),
            F.when(s % 3 == 2, "").otherwise("web page").alias("evidence"),
            F.lit("same town").alias("location_validation"),
            F.when(s % 3 == 0, "Approved").when(s % 3 == 1, "rejected").otherwise("approved").alias("review_status"),
            s.alias("row_ix"),
        )

    @cached_property
    def matching(self) -> Matching:
        return Matching(self.operators, self.links, approved_aliases(self.alias_rows), self.workspace)

    @cached_property
    def matching_without_source(self) -> Matching:
        return Matching(self.operators, None)

    @cached_property
    def flags(self) -> DataFrame:
        return funnel.operator_flags(
            self.operators, self.matching.matched_operators(), links.common_year_permit(self.per_permit),
            self.history_summary,
        )

    @cached_property
    def feed_states(self) -> DataFrame:
        """Outcome of each selected archive."""
        c = F.substring("feed_id", 5, 18).cast("bigint")
        return self.selection.where("status = 'selected'").select(
            "organization_id", "feed_id",
            F.when(c % 6 == 0, "no_bus_route_type").otherwise("bus_feed_analyzed").alias("status"),
            F.when(c % 6 == 0, F.lit(0)).otherwise(c % 3).cast("bigint").alias("bus_agency_count"),
        )

    @cached_property
    def audit_counts(self) -> DataFrame:
        return funnel.audit_counts(
            self.registry, self.selection, self.feed_states, self.agency_records, self.operators,
            self.history_summary,
        )


def sql_norm(column: str) -> str:
    return sql_name(f"replace({column}, '㈱', '')")


def sql_valued(column: str) -> str:
    return f"({column} IS NOT NULL AND {column} NOT IN ('', '-', '－', 'NA', 'N/A', 'null', 'None'))"


view("links_rows", "", f"""
SELECT *, CASE WHEN operator_name <> '' OR operator_number <> '' THEN
  'L-' || substr(sha256(CASE WHEN operator_number <> '' THEN operator_number
    ELSE {sql_norm('operator_name')} || '|' || prefecture_address END), 1, 16) END AS links_operator_id
FROM (
SELECT CASE WHEN (c // 60) % 2 = 0 THEN 'yusoujisseki_' ELSE 'busreport_' END || (c % 4) || '.csv' AS source_file,
       c AS source_row,
       CASE WHEN (c // 60) % 2 = 0 THEN 'transport_performance' ELSE 'business_overview' END AS dataset,
       CASE WHEN c % 37 = 0 THEN '' WHEN c % 3 = 0 THEN 'バス' || k WHEN c % 3 = 1 AND c % 2 = 0 THEN '㈱バス' || k
            WHEN c % 3 = 1 THEN 'バス' || k || '株式会社' ELSE '交通' || k END AS operator_name,
       CASE WHEN k % 4 = 0 THEN '' WHEN k % 7 = 0 OR k = 27 THEN 'N' || (c % 120) ELSE 'N' || k END AS operator_number,
       CASE WHEN c % 4 = 3 THEN '' ELSE CAST((c // 120) % 5 + 2020 AS VARCHAR) END AS year,
       c_mktsegment AS permit_type, 'L' || k AS prefecture_address,
       CASE WHEN c % 7 = 0 THEN '-' WHEN c % 10 = 0 THEN '' ELSE CAST(c AS VARCHAR) END AS passenger_count,
       CASE WHEN c_acctbal < 0 THEN '' ELSE CAST(c % 90 AS VARCHAR) END AS vehicle_count,
       CASE WHEN c % 9 = 0 THEN 'N/A' ELSE '1' END AS revenue,
       CASE WHEN c % 4 = 3 OR c % 6 = 0 THEN '' ELSE '5' END AS driver_count,
       CASE WHEN c % 5 = 0 THEN '' ELSE '9' END AS actual_count
FROM (SELECT c_custkey AS c, c_custkey % 60 AS k, c_mktsegment, c_acctbal FROM customer))
""")
view("links", "links_rows", f"""
SELECT links_operator_id, first(operator_name ORDER BY source_file, source_row) AS operator_name,
       first(operator_number ORDER BY source_file, source_row) AS operator_number,
       first(prefecture_address ORDER BY source_file, source_row) AS prefecture_address,
       coalesce(string_agg(DISTINCT nullif(year, ''), '|' ORDER BY nullif(year, '')), '') AS years,
       string_agg(DISTINCT dataset, '|' ORDER BY dataset) AS datasets, count(*) AS source_rows,
       bool_or({sql_valued('driver_count')}) AS has_driver_count,
       bool_or(dataset = 'transport_performance') AS has_transport_performance,
       bool_or(dataset = 'business_overview') AS has_business_overview,
       first(source_file ORDER BY source_file, source_row) AS first_file,
       first(source_row ORDER BY source_file, source_row) AS first_row
FROM links_rows WHERE links_operator_id IS NOT NULL GROUP BY links_operator_id
""")


def permit_sql(valued) -> str:
    p, v, r, d = (valued(c) for c in ("passenger_count", "vehicle_count", "revenue", "driver_count"))
    return f"""
SELECT links_operator_id, year, trim(permit_type) AS permit_type,
       bool_or(dataset = 'transport_performance') AS in_transport,
       bool_or(dataset = 'business_overview') AS in_overview,
       bool_or(dataset = 'transport_performance' AND {p} AND {v} AND {r}) AS transport_complete,
       bool_or(dataset = 'transport_performance' AND {p} AND {v} AND {r} AND {d}) AS driver_complete
FROM links_rows WHERE links_operator_id IS NOT NULL AND year <> '' GROUP BY ALL"""


view("per_permit", "links_rows", permit_sql(sql_valued))
view("common", "per_permit", """
SELECT links_operator_id, year AS common_links_year, permit_type AS common_permit_type,
       transport_complete, driver_complete
FROM per_permit WHERE in_transport AND in_overview
QUALIFY row_number() OVER (PARTITION BY links_operator_id ORDER BY year DESC, permit_type DESC) = 1
""")
view("agency_records", "agency", f"""
SELECT substr(sha256(operator_identity_key), 1, 16) AS operator_id, *
FROM (SELECT *, {sql_name('agency_name')} || '|' || CASE WHEN {sql_host('agency_url')} <> '' THEN {sql_host('agency_url')}
        ELSE 'publisher:' || organization_id || '|pref:' || prefecture END AS operator_identity_key
  FROM (SELECT agency_name, 'a' || s AS agency_id, agency_url, 'Publisher ' || organization_id AS publisher_name,
       organization_id, feed_id, version_selector, {sql_prefecture('code')} AS prefecture,
       s % 7 + 1 AS route_count, s % 50 AS trip_count, s % 30 AS stop_count, s % 4 AS service_id_count,
       CASE WHEN s % 2 = 0 THEN '3|11' ELSE '3|715' END AS route_types,
       CASE WHEN s % 6 <> 0 THEN s * 1.5::DOUBLE END AS wt, CASE WHEN s % 6 <> 0 THEN s * 0.5::DOUBLE END AS et,
       CASE WHEN s % 5 <> 0 THEN s::DOUBLE END AS wh, CASE WHEN s % 5 <> 0 THEN s / 4.0::DOUBLE END AS eh,
       s * 3.0::DOUBLE AS wk, s * 2.0::DOUBLE AS ek,
       CASE WHEN s % 7 <> 0 THEN 'dated_calendar_applied' ELSE 'missing_calendar_or_validity' END AS schedule_status,
       s AS source_ix
  FROM (SELECT *, row_ix AS s, CASE CAST(substr(feed_id, 5) AS INTEGER) WHEN 3 THEN 99 WHEN 5 THEN 60
               ELSE CAST(substr(feed_id, 5) AS INTEGER) + 14 END AS code FROM agency)))
""")


def rollup_sql(source: str, m: tuple[str, ...]) -> str:
    def joined(c: str) -> str:
        return f"string_agg(DISTINCT {c}, '|' ORDER BY {c})"

    names = ["weekday_trips_per_day_sum_approx", "weekend_trips_per_day_sum_approx", "weekday_trip_hours_sum_approx",
             "weekend_trip_hours_sum_approx", "weekday_km_sum_approx", "weekend_km_sum_approx"]
    sums = ", ".join(f"round(sum({c}), 3) AS {n}" for c, n in zip(m, names))
    order = "organization_id, feed_id, version_selector, source_ix, agency_id"
    return f"""
SELECT operator_id, operator_identity_key, first(agency_name ORDER BY {order}) AS agency_name,
       first(agency_url ORDER BY {order}) AS agency_url, {joined('prefecture')} AS prefectures,
       {joined('publisher_name')} AS publisher_names, {joined('feed_id')} AS feed_ids,
       {joined("organization_id || '/' || feed_id")} AS organization_feed_pairs, {joined('agency_id')} AS agency_ids,
       count(DISTINCT feed_id) AS feed_count, count(DISTINCT organization_id || '/' || feed_id) AS feed_pair_count,
       count(*) AS agency_record_count, CAST(sum(route_count) AS BIGINT) AS routes_sum_across_feeds,
       CAST(sum(trip_count) AS BIGINT) AS trips_sum_across_feeds, CAST(sum(stop_count) AS BIGINT) AS stops_sum_across_feeds,
       CAST(sum(service_id_count) AS BIGINT) AS service_id_sum_across_feeds,
       array_to_string(list_sort(list_distinct(flatten(list(string_split(route_types, '|'))))), '|') AS route_types,
       {sums}, bool_and(schedule_status = 'dated_calendar_applied') AS schedule_status_all_dated
FROM {source} GROUP BY operator_id, operator_identity_key"""


view("operators", "agency_records", rollup_sql("agency_records", ("wt", "et", "wh", "eh", "wk", "ek")))
view("first_record", "agency_records", "SELECT operator_id, min(source_ix) AS s FROM agency_records GROUP BY 1")
view("history_summary", "first_record", """
SELECT operator_id, CASE WHEN s % 4 < 2 THEN true WHEN s % 4 = 2 THEN false END AS years_2plus_all_feeds,
       CASE WHEN s % 4 = 0 THEN true WHEN s % 4 < 3 THEN false END AS years_3plus_all_feeds FROM first_record
""")
view("alias_rows", "agency_records", """
SELECT operator_id, 'L-' || substr(sha256('N9'), 1, 16) AS links_operator_id,
       CASE WHEN source_ix % 3 = 2 THEN '' ELSE 'web page' END AS evidence, 'same town' AS location_validation,
       CASE source_ix % 3 WHEN 0 THEN 'Approved' WHEN 1 THEN 'rejected' ELSE 'approved' END AS review_status,
       source_ix AS row_ix
FROM agency_records WHERE source_ix % 40 = 38
""")
view("approved", "alias_rows", """
SELECT * FROM alias_rows WHERE lower(review_status) = 'approved' AND evidence <> '' AND location_validation <> ''
""")
view("named_links", "links", f"""
SELECT *, trim(operator_name) AS name, {sql_norm('operator_name')} AS key FROM links WHERE trim(operator_name) <> ''
""")
view("op_names", "operators", f"""
SELECT operator_id, agency_name, agency_url, prefectures, trim(agency_name) AS name, {sql_norm('agency_name')} AS key FROM operators
""")
for by, label in (("name", "exact"), ("key", "normal")):
    view(f"{label}_names", "named_links", f"""
SELECT {by}, count(DISTINCT links_operator_id) = 1 AS {label}_single,
       first(links_operator_id ORDER BY first_file, first_row) AS {label}_id
FROM named_links GROUP BY {by}
""")
view("name_classes", "op_names exact_names normal_names approved links", """
SELECT o.*, exact_single, exact_id, normal_single, normal_id,
       CASE WHEN exact_single THEN 'A' WHEN exact_id IS NULL AND normal_single THEN 'B'
            WHEN exact_id IS NULL AND normal_id IS NULL AND alias_id IS NOT NULL THEN 'C' END AS name_class,
       CASE WHEN exact_single THEN exact_id WHEN exact_id IS NULL AND normal_single THEN normal_id
            WHEN exact_id IS NULL AND normal_id IS NULL THEN alias_id END AS link_id
FROM op_names o LEFT JOIN exact_names USING (name) LEFT JOIN normal_names USING (key)
LEFT JOIN (SELECT operator_id, first(links_operator_id ORDER BY row_ix) AS alias_id
           FROM approved SEMI JOIN links USING (links_operator_id) GROUP BY operator_id) USING (operator_id)
""")
# Ratcliff/Obershelp by recursion over all pairs: the longest common block (earliest in the left name, then in the
# right one), then what is left and right of it.
view("open_names", "name_classes", "SELECT * FROM name_classes WHERE name_class IS NULL AND key <> ''")
view("ratio_pairs", "open_names named_links", """
SELECT l, r, row_number() OVER () AS p FROM (SELECT DISTINCT key AS l FROM open_names), (SELECT DISTINCT key AS r FROM named_links WHERE key <> '')
""")
view("common_blocks", "ratio_pairs", """
SELECT p, i, j, max(k) AS k FROM ratio_pairs, range(1, length(l) + 1) AS a(i), range(1, length(r) + 1) AS b(j),
  range(1, least(length(l) - i, length(r) - j) + 2) AS c(k)
WHERE substr(l, i::INTEGER, k::INTEGER) = substr(r, j::INTEGER, k::INTEGER) GROUP BY p, i, j
""")
view("segments", "ratio_pairs common_blocks", """
SELECT p, 1::BIGINT AS alo, length(l) + 1 AS ahi, 1::BIGINT AS blo, length(r) + 1 AS bhi FROM ratio_pairs
UNION ALL
SELECT p, CASE side WHEN 0 THEN alo ELSE i + n END, CASE side WHEN 0 THEN i ELSE ahi END,
       CASE side WHEN 0 THEN blo ELSE j + n END, CASE side WHEN 0 THEN j ELSE bhi END
FROM (SELECT s.p, alo, ahi, blo, bhi, i, j, least(k, ahi - i, bhi - j) AS n,
             row_number() OVER (PARTITION BY s.p, alo, ahi, blo, bhi ORDER BY least(k, ahi - i, bhi - j) DESC, i, j) AS no
      FROM segments s JOIN common_blocks b ON b.p = s.p AND i >= alo AND i < ahi AND j >= blo AND j < bhi),
     (VALUES (0), (1)) AS sides(side) WHERE no = 1
""")
view("ratios", "segments common_blocks ratio_pairs", """
SELECT l, r, 2.0::DOUBLE * coalesce(m, 0) / (length(l) + length(r)) AS score
FROM ratio_pairs LEFT JOIN (
  SELECT p, sum(n) AS m FROM (
    SELECT s.p, least(k, ahi - i, bhi - j) AS n,
           row_number() OVER (PARTITION BY s.p, alo, ahi, blo, bhi ORDER BY least(k, ahi - i, bhi - j) DESC, i, j) AS no
    FROM segments s JOIN common_blocks b ON b.p = s.p AND i >= alo AND i < ahi AND j >= blo AND j < bhi)
  WHERE no = 1 GROUP BY p) USING (p)
""")
view("similar_names", "ratios open_names named_links", """
SELECT o.operator_id, o.name AS agency_name, o.agency_url, o.prefectures, t.links_operator_id AS candidate_links_operator_id,
       t.operator_name AS candidate_links_name, t.prefecture_address AS candidate_location, round(score, 4) AS score
FROM open_names o JOIN (
  SELECT *, row_number() OVER (PARTITION BY l ORDER BY score DESC, operator_name, first_file, first_row) AS rank
  FROM ratios JOIN named_links n ON n.key = r WHERE score >= 0.55) t ON o.key = t.l
WHERE rank <= 3
""")
view("all_classes", "name_classes similar_names", """
SELECT c.*, coalesce(name_class, CASE WHEN operator_id IN (SELECT operator_id FROM similar_names) THEN 'D' ELSE 'E' END) AS match_class
FROM name_classes c
""")
view("flags", "operators name_classes links common history_summary", """
SELECT o.operator_id, o.agency_name, o.prefectures, name_class, c.link_id AS links_operator_id,
       l.operator_name AS links_operator_name, common_links_year, common_permit_type,
       c.link_id IS NOT NULL AS matched, coalesce(transport_complete, false) AS t,
       common_links_year IS NOT NULL AS o, coalesce(driver_complete, false) AS d,
       years_2plus_all_feeds AS h2, years_3plus_all_feeds AS h3,
       coalesce(transport_complete AND driver_complete AND years_3plus_all_feeds, false) AS complete
FROM operators o JOIN (SELECT operator_id, name_class, link_id FROM name_classes) c USING (operator_id)
LEFT JOIN links l ON l.links_operator_id = c.link_id
LEFT JOIN common ON common.links_operator_id = c.link_id
LEFT JOIN history_summary USING (operator_id)
""")
