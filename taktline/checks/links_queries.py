"""Operator statistics, name match and funnel over the derived views."""

from __future__ import annotations

from pyspark.sql import functions as F

from taktline.checks.catalog_views import ANCHOR
from taktline.checks.links_views import LinksViews as Views, permit_sql, rollup_sql, sql_norm, sql_valued
from taktline.checks.registry import query
from taktline.checks.views import text
from taktline.constants import FIELD_TERMS
from taktline.functions import prefecture_name, url_host, normalize_name
from taktline.operators import funnel, links
from taktline.operators.service import operator_rollup
from taktline.sources.lists import approved_aliases

ROW = ("source_file, source_row, dataset, operator_name, operator_number, year, permit_type, prefecture_address, "
       "passenger_count, vehicle_count, revenue, driver_count, links_operator_id")


@query("operator_rollup", "agency_metrics", rollup_sql("agency_metrics", (
    "weekday_trips_per_day_avg", "weekend_trips_per_day_avg", "weekday_trip_hours_per_day_approx",
    "weekend_trip_hours_per_day_approx", "weekday_km_per_day_straight_line_approx",
    "weekend_km_per_day_straight_line_approx")))
def _(v: Views):
    return operator_rollup(v.agency_metrics)


@query("map_fields", "links_rows", f"SELECT {ROW} FROM links_rows")
def _(v: Views):
    return v.links_rows.drop("driver_valued", "path")


@query("row_normalization", "links_rows", f"""
SELECT source_file, source_row, '事業者名' AS links_name_column, operator_name AS links_name_raw,
       {sql_norm('operator_name')} AS links_name_key, permit_type AS field_permit
FROM links_rows""")
def _(v: Views):
    rows = links.row_normalization(v.records)
    return rows.select("*", F.col("fields")["field_事業区分"].alias("field_permit")).drop("fields")


@query("normalized_operators", "operators", f"""
SELECT operator_id, {sql_norm('agency_name')} AS agency_name_key,
       regexp_replace(publisher_names, '\\s+', '', 'g') AS publisher_name_key FROM operators""")
def _(v: Views):
    return links.normalized_operators(v.operators).select("operator_id", "agency_name_key", "publisher_name_key")


@query("links_operator_rollup", "links", "SELECT * FROM links")
def _(v: Views):
    return v.links.drop("row_ix", "first_path")


def completeness_sql() -> str:
    present = {
        "operator_name": ("事業者名|事業者番号", "operator_name", "operator_number"), "operator_number": ("事業者番号", "operator_number"),
        "year": ("対象年度", "year"), "permit_type": ("事業区分", "permit_type"), "address": ("住所", "prefecture_address"),
        "vehicle_count": ("車両数", "vehicle_count"), "extended_actual_vehicle_count": ("延実在車両数", "actual_count"),
        "passenger_count": ("輸送人員", "passenger_count"), "revenue": ("営業収入", "revenue"),
        "sales_revenue": ("営業収入", "revenue"), "driver_count": ("運転者数", "driver_count"),
    }
    parts = []
    for field in FIELD_TERMS:
        names, *cells = present.get(field, ("",))
        hit = " OR ".join(sql_valued(c) for c in cells) or "false"
        if field in ("year", "driver_count"):
            names = f"CASE WHEN source_file LIKE '%3.csv' THEN '' ELSE '{names}' END"
        else:
            names = f"'{names}'"
        parts.append(f"""
SELECT dataset, source_file, year, '{field}' AS field, {names} AS columns, count(*) AS rows_total,
       count(*) FILTER ({hit}) AS rows_nonblank,
       count(DISTINCT links_operator_id) FILTER (({hit}) AND {sql_valued('operator_name')}) AS unique_operator_ids_nonblank
FROM links_rows GROUP BY dataset, source_file, year""")
    return f"""
SELECT *, CASE WHEN columns <> '' THEN 'measured_from_csv' ELSE 'column_not_present' END AS status,
       '{links.GRAIN_NOTE}' AS grain_note
FROM ({' UNION ALL '.join(parts)})"""


@query("field_completeness", "links_rows", completeness_sql())
def _(v: Views):
    return links.field_completeness(v.records).drop("path")


@query("transport_complete", "per_permit", "SELECT * FROM per_permit")
def _(v: Views):
    return v.per_permit


@query("transport_complete_separators", "links_rows", permit_sql(lambda c: f"trim({c}, '| ') <> ''"))
def _(v: Views):
    return links.transport_complete(v.links_rows, "separators")


@query("common_year_permit", "common", "SELECT * FROM common")
def _(v: Views):
    return links.common_year_permit(v.per_permit)


@query("normalize_name", "links_rows agency", f"""
SELECT operator_name AS name, {sql_norm('operator_name')} AS key, count(*) AS n FROM links_rows GROUP BY ALL
UNION ALL SELECT agency_name, {sql_norm('agency_name')}, count(*) FROM agency GROUP BY ALL""")
def _(v: Views):
    names = [v.links_rows.select(F.col("operator_name").alias("name")), v.agency.select(F.col("agency_name").alias("name"))]
    counted = [n.groupBy("name").agg(F.count("*").alias("n")) for n in names]
    return counted[0].unionAll(counted[1]).select("name", normalize_name(F.col("name")).alias("key"), "n")


@query("url_host", "", r"""
SELECT host, count(*) AS n FROM (SELECT regexp_replace(lower(regexp_extract(url,
  '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#]*@)?([^/:?#]+)', 1)), '^www\.', '') AS host FROM pages) GROUP BY host""")
def _(v: Views):
    return v.table("pages").groupBy(url_host(F.col("url")).alias("host")).agg(F.count("*").alias("n"))


@query("pref_name", "registry", """
SELECT feed_id, CASE feed_pref_id WHEN 1 THEN '北海道' WHEN 13 THEN '東京都' WHEN 20 THEN '長野県' WHEN 26 THEN '京都府'
  WHEN 27 THEN '大阪府' WHEN 38 THEN '愛媛県' WHEN 47 THEN '沖縄県' WHEN 99 THEN '全国'
  ELSE CASE WHEN feed_pref_id BETWEEN 1 AND 47 THEN '県' ELSE '不明' END END AS kind
FROM registry""")
def _(v: Views):
    name = prefecture_name(F.col("feed_pref_id"))
    return v.registry.select("feed_id", F.when(
        name.isin("全国", "不明", "北海道", "東京都", "長野県", "京都府", "大阪府", "愛媛県", "沖縄県"), name).otherwise("県").alias("kind"))


@query("src_aliases", "approved", "SELECT * FROM approved")
def _(v: Views):
    return approved_aliases(v.alias_rows)


# -- match --------------------------------------------------------------------


@query("match_exact", "name_classes", "SELECT operator_id, exact_id AS links_operator_id FROM name_classes WHERE exact_single")
def _(v: Views):
    return v.matching.match_exact()


@query("match_normalized", "name_classes", """
SELECT operator_id, normal_id AS links_operator_id FROM name_classes WHERE exact_id IS NULL AND normal_single""")
def _(v: Views):
    return v.matching.match_normalized()


@query("match_alias", "approved links", """
SELECT operator_id, first(links_operator_id ORDER BY row_ix) AS links_operator_id
FROM approved SEMI JOIN links USING (links_operator_id) GROUP BY operator_id""")
def _(v: Views):
    return v.matching.match_alias().select("operator_id", "alias.links_operator_id")


AMBIGUOUS_SQL = """
SELECT operator_id, o.name AS agency_name, l.links_operator_id AS candidate_links_operator_id,
       l.operator_name AS candidate_links_name, 1.0::DOUBLE AS score,
       'exact_name_ambiguous_multiple_LINKS_entities' AS candidate_type, false AS auto_accepted
FROM name_classes o JOIN named_links l ON o.name = l.name WHERE NOT exact_single
UNION ALL
SELECT operator_id, o.name, l.links_operator_id, l.operator_name, 1.0::DOUBLE,
       'normalized_name_ambiguous_multiple_LINKS_entities', false
FROM name_classes o JOIN named_links l ON o.key = l.key WHERE exact_id IS NULL AND NOT normal_single"""


@query("match_ambiguous", "name_classes named_links", AMBIGUOUS_SQL)
def _(v: Views):
    return v.matching.match_ambiguous()


@query("match_cascade", "name_classes links", """
SELECT operator_id, c.name AS gtfs_agency_name, agency_url, prefectures AS gtfs_prefectures,
       link_id AS links_operator_id, operator_name AS links_operator_name, prefecture_address AS links_location,
       operator_number AS links_operator_number, name_class AS match_class,
       CASE name_class WHEN 'A' THEN 'raw agency_name equals LINKS operator_name'
            WHEN 'B' THEN 'NFKC/whitespace/legal-form normalized name equality'
            ELSE 'manually reviewed alias; evidence and location validation supplied' END AS match_basis,
       'unique name candidate; C alias additionally reviewed' AS link_validation, source_rows
FROM name_classes c JOIN links ON links_operator_id = link_id""")
def _(v: Views):
    return v.matching.matched_operators()


@query("match_fuzzy", "similar_names name_classes named_links", f"""
SELECT operator_id, agency_name, agency_url, prefectures, candidate_links_operator_id, candidate_links_name, candidate_location,
       score, 'fuzzy_review_required' AS candidate_type, false AS auto_accepted FROM similar_names
UNION ALL BY NAME ({AMBIGUOUS_SQL})""")
def _(v: Views):
    return v.matching.fuzzy_candidates()


@query("unmatched_left", "all_classes", """
SELECT operator_id, name AS agency_name, agency_url, prefectures, match_class,
       CASE match_class WHEN 'D' THEN 'fuzzy candidate(s) exist; no automatic acceptance'
            ELSE 'no exact, normalized, approved-alias, or fuzzy candidate' END AS reason
FROM all_classes WHERE match_class IN ('D', 'E')""")
def _(v: Views):
    return v.matching.unmatched_left()


@query("unmatched_right", "links name_classes", """
SELECT links.*, 'not confirmed as a GTFS bus agency match' AS reason FROM links
ANTI JOIN (SELECT link_id AS links_operator_id FROM name_classes WHERE link_id IS NOT NULL) USING (links_operator_id)""")
def _(v: Views):
    return v.matching.unmatched_right().drop("row_ix", "first_path")


NOTES = {"A": "raw exact name", "B": "normalized exact name", "C": "manual approved alias",
         "D": "fuzzy candidates only, not accepted", "E": "no candidate after a complete LINKS comparison"}
TOTAL = """SELECT 'GTFS_total' AS match_class, count(*) AS confirmed_or_candidate_count,
  'measured_from_internal_GTFS_agency_names' AS status,
  'Canonical entities across current GTFS feeds, not feed count' AS note FROM operators"""


@query("match_summary", "all_classes operators", " UNION ALL ".join(
    f"SELECT '{c}' AS match_class, count(*) FILTER (match_class = '{c}') AS confirmed_or_candidate_count, "
    f"'measured' AS status, '{n}' AS note FROM all_classes" for c, n in NOTES.items()) + " UNION ALL " + TOTAL)
def _(v: Views):
    return v.matching.match_summary()


@query("match_summary_source_missing", "operators", " UNION ALL ".join(
    f"SELECT '{c}' AS match_class, CAST(NULL AS BIGINT) AS confirmed_or_candidate_count, "
    f"'not_evaluable_LINKS_data_unavailable' AS status, '{n}' AS note" for c, n in NOTES.items()) + " UNION ALL " + TOTAL)
def _(v: Views):
    return v.matching_without_source.match_summary()


# -- funnel -------------------------------------------------------------------


@query("operator_detail", "flags", """
SELECT operator_id, agency_name, prefectures, coalesce(name_class, 'E') AS match_class, links_operator_id,
       links_operator_name, common_links_year, common_permit_type, t AS transport_performance_complete,
       o AS business_overview_present, d AS driver_count_complete, h2 AS gtfs_2plus_year_history,
       h3 AS gtfs_3plus_year_history, '' AS drop_reason FROM flags""")
def _(v: Views):
    return funnel.operator_detail(v.flags)


def stages_sql(available: bool) -> str:
    counts = ["count(*)", "count(*) FILTER (matched)", "count(*) FILTER (t)", "count(*) FILTER (t AND o)",
              "count(*) FILTER (t AND o AND d)", "count(*) FILTER (t AND o AND d AND h2)",
              "count(*) FILTER (t AND o AND d AND h3)"]
    rows = []
    for i, (stage, status) in enumerate(funnel.STAGES):
        known = available or i == 0
        rows.append(f"SELECT '{stage}' AS stage, {counts[i] if known else 'CAST(NULL AS BIGINT)'} AS operator_count, "
                    f"'{status if known else 'not_evaluable_LINKS_source_unavailable'}' AS status FROM flags"
                    + ("" if known else " LIMIT 1"))
    return " UNION ALL ".join(f"({r})" for r in rows)


@query("funnel", "flags", stages_sql(True))
def _(v: Views):
    return funnel.funnel(v.flags)


@query("funnel_source_missing", "flags", stages_sql(False))
def _(v: Views):
    return funnel.funnel(v.flags, available=False)


LISTED = f"(SELECT unnest({[*funnel.PREFECTURES]}) AS p)"
PREFECTURE_SQL = f"""
SELECT p AS prefecture, count(operator_id) AS gtfs_bus_operator_entities,
       count(*) FILTER (matched) AS links_matched_A_B_C, count(*) FILTER (complete) AS full_complete,
       coalesce(round(count(*) FILTER (complete) / nullif(count(operator_id), 0)::DOUBLE, 4), 0) AS coverage_rate,
       'measured' AS links_status
FROM (SELECT p FROM {LISTED} UNION ALL SELECT '全国・都道府県不明')
LEFT JOIN (SELECT DISTINCT operator_id, coalesce(listed.p, '全国・都道府県不明') AS prefecture, matched, complete
           FROM (SELECT *, unnest(string_split(prefectures, '|')) AS q FROM flags)
           LEFT JOIN {LISTED} listed ON listed.p = q) ON prefecture = p
GROUP BY p"""


@query("prefecture_summary", "flags", PREFECTURE_SQL)
def _(v: Views):
    return funnel.prefecture_summary(v.flags)


@query("region_detail", "flags", """
SELECT operator_id, agency_name, prefectures, coalesce(name_class, 'E') AS match_class, links_operator_id,
       links_operator_name, common_links_year, common_permit_type, t AS transport_performance_complete,
       o AS business_overview_present, d AS driver_count_complete, h2 AS gtfs_2plus_year_history,
       h3 AS gtfs_3plus_year_history, '' AS drop_reason,
       agency_name LIKE '%伊予鉄%' OR agency_name LIKE '%いよてつ%' AS name_check,
       CAST(NULL AS VARCHAR) AS gtfs_status, CAST(NULL AS BIGINT) AS registry_feed_rows
FROM flags WHERE prefectures LIKE '%愛媛県%'""")
def _(v: Views):
    return funnel.region_detail(v.flags, v.registry)


@query("region_detail_none_found", "registry", """
SELECT CAST(NULL AS VARCHAR) AS operator_id, CAST(NULL AS VARCHAR) AS agency_name, '北海道' AS prefectures,
       'not_evaluable' AS match_class, CAST(NULL AS VARCHAR) AS links_operator_id,
       CAST(NULL AS VARCHAR) AS links_operator_name, CAST(NULL AS VARCHAR) AS common_links_year,
       CAST(NULL AS VARCHAR) AS common_permit_type, CAST(NULL AS BOOLEAN) AS transport_performance_complete,
       CAST(NULL AS BOOLEAN) AS business_overview_present, CAST(NULL AS BOOLEAN) AS driver_count_complete,
       CAST(NULL AS BOOLEAN) AS gtfs_2plus_year_history, CAST(NULL AS BOOLEAN) AS gtfs_3plus_year_history,
       CAST(NULL AS VARCHAR) AS drop_reason, CAST(NULL AS BOOLEAN) AS name_check,
       'not_found_in_official_registry_or_selected_agency_txt' AS gtfs_status, count(*) AS registry_feed_rows
FROM registry WHERE feed_pref_id = 1""")
def _(v: Views):
    return funnel.region_detail(v.flags, v.registry, "北海道", 1)


def indicators_sql() -> str:
    rule = {"year": "count(*) FILTER (t AND o)", "driver": "count(*) FILTER (t AND d)", "none": "CAST(NULL AS BIGINT)"}
    rows = []
    for code, name, needs, kind in funnel.INDICATORS:
        lead = f"SELECT '{code}' AS indicator, '{name}' AS name, '{needs}' AS required_data, "
        if kind == "supply":
            n = "count(*) FILTER (s % 5 = 0)"
            rows.append(lead + f"""{n} AS operators_with_required_data,
  CASE WHEN {n} > 0 THEN 'partially_possible_GTFS_only' ELSE 'not_confirmed_in_downloaded_GTFS_history' END AS feasibility,
  CASE WHEN {n} > 0 THEN '一部可能（GTFS時刻表だけで供給量前年比を確認）' ELSE '今回の取得履歴では未確認' END AS requested_category,
  'measured_from_GTFS_history' AS true_population_count_status,
  'Measured from distinct dated timetables in all component feeds; LINKs is not required for this GTFS-only change.' AS limitations FROM first_record""")
        else:
            n = rule[kind]
            rows.append("(" + lead + f"""{n} AS operators_with_required_data,
  CASE WHEN {n} > 0 THEN 'partially_possible; exact numerator/denominator matching must be checked' ELSE 'not_computable_from_measured_rows' END AS feasibility,
  CASE WHEN {n} > 0 THEN '一部可能' ELSE '不可能（今回実査した行では計算不可）' END AS requested_category,
  'measured_from_source_rows' AS true_population_count_status,
  'Computed count is a conservative row-availability count, not a claim that the ratio is comparable across permit classes.' AS limitations FROM flags{' LIMIT 1' if kind == 'none' else ''})""")
    return " UNION ALL ".join(rows)


@query("indicator_feasibility", "flags first_record", indicators_sql())
def _(v: Views):
    return funnel.indicator_feasibility(v.flags, v.supply)


COUNTS = {
    "registry": "(SELECT count(*) FROM registry)",
    "selected": "(SELECT count(*) FROM selection WHERE status = 'selected')",
    "discontinued": "(SELECT count(*) FROM selection WHERE status LIKE 'excluded_discontinued%')",
    "no_archive": "(SELECT count(*) FROM selection WHERE status = 'no_downloaded_archive_valid_on_anchor')",
    "bus_feeds": "(SELECT count(*) FROM selection WHERE status = 'selected' AND CAST(substr(feed_id, 5) AS BIGINT) % 6 <> 0)",
    "no_bus_feeds": "(SELECT count(*) FROM selection WHERE status = 'selected' AND CAST(substr(feed_id, 5) AS BIGINT) % 6 = 0)",
    "multi_agency_feeds": "(SELECT count(*) FROM selection WHERE status = 'selected' AND CAST(substr(feed_id, 5) AS BIGINT) % 6 <> 0 AND CAST(substr(feed_id, 5) AS BIGINT) % 3 > 1)",
    "agency_rows": "(SELECT count(*) FROM agency_records)",
    "named_feeds": "(SELECT count(DISTINCT (organization_id, feed_id)) FROM agency_records)",
    "entities": "(SELECT count(*) FROM operators)",
    "names": "(SELECT count(DISTINCT agency_name) FROM operators)",
    "undated": "(SELECT count(*) FROM operators WHERE NOT schedule_status_all_dated)",
    "multi_feed": "(SELECT count(*) FROM operators WHERE feed_count > 1)",
    "municipal": "(SELECT count(*) FROM operators WHERE regexp_matches(agency_name, '(市|区|町|村)$'))",
    "council": "(SELECT count(*) FROM operators WHERE agency_name LIKE '%協議会%')",
    "history_2": "(SELECT count(*) FROM history_summary WHERE years_2plus_all_feeds)",
    "history_3": "(SELECT count(*) FROM history_summary WHERE years_3plus_all_feeds)",
    None: "CAST(NULL AS BIGINT)",
}


def note_sql(text: str) -> str:
    most = "(SELECT coalesce(max(feed_count), 0) FROM operators)"
    return "'" + text.replace("'", "''").replace("{anchor}", str(ANCHOR)).replace("{max_feeds}", f"' || {most} || '") + "'"


AUDIT = "registry selection agency_records operators history_summary"


@query("data_gap_summary", AUDIT, " UNION ALL ".join(
    f"SELECT '{gap}' AS gap_or_grain, {COUNTS[n]} AS count, {COUNTS[d]} AS denominator, "
    f"round({COUNTS[n]}::DOUBLE / nullif({COUNTS[d]}, 0), 4) AS rate, '{unit}' AS unit, '{status}' AS status, {note_sql(funnel.GAP_NOTES[gap])} AS note"
    for gap, n, d, unit, status in funnel.GAPS))
def _(v: Views):
    return funnel.data_gap_summary(v.audit_counts, ANCHOR)


@query("grain_summary", AUDIT, " UNION ALL ".join(
    f"SELECT '{grain}' AS grain, {COUNTS[n]} AS count, '{unit}' AS unit, "
    f"{note_sql(funnel.GRAIN_NOTES[grain])} AS note"
    for grain, n, unit in funnel.GRAINS))
def _(v: Views):
    return funnel.grain_summary(v.audit_counts)


@query("verdict", "flags", """
SELECT count(*) FILTER (complete) AS full_complete,
       CASE WHEN count(*) FILTER (complete) >= 20 THEN 'CONDITIONAL PASS' ELSE 'FAIL' END AS verdict FROM flags""")
def _(v: Views):
    return funnel.verdict(v.flags)


# -- files that share a member name, odd white space, blank prefectures --------


@query("field_completeness_by_file", "", """
SELECT path, 'report.csv' AS source_file, field, columns, rows_total, rows_nonblank FROM (
  SELECT 'z' || n_nationkey % 2 || '.zip' AS path, count(*) AS rows_total,
         count(*) FILTER (n_nationkey % 3 <> 0) AS named, count(*) FILTER (n_nationkey % 2 = 0 AND n_nationkey % 5 <> 0) AS driven
  FROM nation GROUP BY 1)
CROSS JOIN LATERAL (VALUES ('operator_name', CASE path WHEN 'z0.zip' THEN '事業者名' ELSE '会社名' END, named),
  ('driver_count', CASE path WHEN 'z0.zip' THEN '運転者数' ELSE '' END, driven)) AS f(field, columns, rows_nonblank)""")
def _(v: Views):
    n = F.col("n_nationkey")
    even = n % 2 == 0
    name = F.when(n % 3 != 0, F.col("n_name")).otherwise("")
    one = F.create_map(F.lit("事業者名"), name, F.lit("運転者数"), F.when(n % 5 != 0, "4").otherwise("-"))
    records = v.table("nation").select(
        F.concat(F.lit("z"), (n % 2).cast("string"), F.lit(".zip")).alias("path"), F.lit("report.csv").alias("source_file"),
        n.alias("source_row"), F.when(even, F.array(F.lit("事業者名"), F.lit("運転者数"))).otherwise(F.array(F.lit("会社名"))).alias("columns"),
        F.when(even, one).otherwise(F.create_map(F.lit("会社名"), name)).alias("row"),
    )
    return links.field_completeness(records).where(F.col("field").isin("operator_name", "driver_count")).select(
        "path", "source_file", "field", "columns", "rows_total", "rows_nonblank")


@query("common_permit_white_space", "", """
SELECT 'L' || c_custkey AS links_operator_id, '2024' AS common_links_year, 'P' || c_nationkey AS common_permit_type,
       true AS transport_complete, c_custkey % 2 = 0 AS driver_complete FROM customer""")
def _(v: Views):
    c = F.col("c_custkey")
    permit = text("P", "c_nationkey")
    rows = v.table("customer").select(
        text("L", c).alias("links_operator_id"), F.lit("2024").alias("year"), F.lit("1").alias("passenger_count"),
        F.lit("2").alias("vehicle_count"), F.lit("3").alias("revenue"), F.when(c % 2 == 0, "4").otherwise("").alias("driver_count"),
        F.explode(F.array(F.struct(F.lit("transport_performance").alias("d"), F.concat(permit, F.lit("　")).alias("p")),
                          F.struct(F.lit("business_overview").alias("d"), F.concat(F.lit("\t"), permit).alias("p")))).alias("x"),
    ).select("*", F.col("x.d").alias("dataset"), F.col("x.p").alias("permit_type")).drop("x")
    return links.common_year_permit(links.transport_complete(rows))


@query("prefecture_blanks", "", """
SELECT CASE WHEN c_custkey % 4 = 2 THEN '愛媛県' ELSE '全国・都道府県不明' END AS prefecture, count(*) AS gtfs_bus_operator_entities
FROM customer WHERE c_custkey % 4 >= 2 GROUP BY 1""")
def _(v: Views):
    c = F.col("c_custkey")
    flags = v.table("customer").select(
        c.cast("string").alias("operator_id"),
        F.when(c % 4 == 1, "").when(c % 4 == 2, "愛媛県|").when(c % 4 == 3, "不明").alias("prefectures"),
        *[F.lit(False).alias(n) for n in ("matched", "transport_complete", "overview_present", "driver_complete", "history_2plus", "history_3plus")])
    return funnel.prefecture_summary(flags).where("gtfs_bus_operator_entities > 0").select("prefecture", "gtfs_bus_operator_entities")


@query("pick_column_headers", "", """
SELECT n_nationkey, CASE n_nationkey % 4 WHEN 0 THEN '事業者番号' WHEN 1 THEN '会社名' WHEN 2 THEN '事業者名' END AS operator_name,
       CASE n_nationkey % 4 WHEN 0 THEN '住所' WHEN 1 THEN '都道府県名' WHEN 2 THEN '所在地' END AS prefecture_address,
       CASE n_nationkey % 4 WHEN 0 THEN '対象年度' WHEN 1 THEN '年度' END AS year,
       CASE n_nationkey % 4 WHEN 0 THEN '車両数' WHEN 2 THEN '車両数（両）' END AS vehicle_count,
       CASE n_nationkey % 4 WHEN 0 THEN '延実在車両数' END AS extended FROM nation""")
def _(v: Views):
    n = F.col("n_nationkey") % 4
    header = lambda *names: F.array(*[F.lit(x) for x in names])
    columns = (
        F.when(n == 0, header("都道府県名", "事業者番号", "住所", "延実在車両数", "対象年度", "車両数"))
        .when(n == 1, header("会社名", "都道府県名", "年度", "備考"))
        .when(n == 2, header("備考", "所在地", "事業者名", "車両数（両）")).otherwise(header("備考")))
    picked, mapped = links.pick_column(columns), links.map_fields(columns)
    first = lambda name: F.get(mapped[name], F.lit(0))
    return v.table("nation").select(
        "n_nationkey", picked["operator_name"].alias("operator_name"), picked["prefecture_address"].alias("prefecture_address"),
        picked["year"].alias("year"), first("vehicle_count").alias("vehicle_count"), first("extended_actual_vehicle_count").alias("extended"))
