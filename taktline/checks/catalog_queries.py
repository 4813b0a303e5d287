"""Catalogue, manifest and history over the derived views."""

from __future__ import annotations

from pyspark.sql import functions as F

from taktline.checks.catalog_views import ANCHOR, FK, KEYS, CatalogViews as Views
from taktline.checks.oracle_views import K
from taktline.checks.registry import query
from taktline.operators import catalog, digest, history, service
from taktline.operators.catalog import A, FEED

REASON = """CASE WHEN feed_is_discontinued AND feed_discontinued_date IS NULL THEN 'discontinued_date_unknown'
  WHEN feed_is_discontinued AND feed_discontinued_date <= DATE '2020-06-25' THEN 'discontinued_on_or_before_anchor'
  WHEN latest_feed_start_date IS NULL OR latest_feed_end_date IS NULL THEN 'missing_validity_dates'
  WHEN DATE '2020-06-25' BETWEEN latest_feed_start_date AND latest_feed_end_date THEN 'valid_on_anchor_date'
  ELSE 'outside_anchor_date' END"""


@query("feed_active_status", "registry", f"""
SELECT *, {REASON} AS reason, {REASON} = 'valid_on_anchor_date' AS active FROM registry""")
def _(v: Views):
    return catalog.feed_active_status(v.registry, ANCHOR)


@query("excluded_feeds", "registry", f"""
SELECT {FK}, {REASON} AS reason, latest_feed_start_date, latest_feed_end_date, feed_is_discontinued
FROM registry WHERE {REASON} <> 'valid_on_anchor_date'""")
def _(v: Views):
    return catalog.excluded_feeds(v.registry, ANCHOR)


@query("successful_archives", "manifest", f"""
SELECT {KEYS}, path, sha256, bytes FROM manifest WHERE status = '200' AND row_ix % 37 <> 0""")
def _(v: Views):
    listing = v.manifest.where("row_ix % 37 <> 0").select("path")
    return catalog.successful_archives(v.manifest, listing).select(*A, "path", "sha256", "bytes")


@query("anchor_select", "selection", "SELECT * FROM selection")
def _(v: Views):
    return v.selection


@query("validity_mismatch", "selection", """
SELECT * FROM selection WHERE status = 'selected'
AND (registry_latest_start IS DISTINCT FROM validity_start OR registry_latest_end IS DISTINCT FROM validity_end)""")
def _(v: Views):
    return catalog.validity_mismatch(v.selection)


@query("selector_counts", "selection", """
SELECT selected_version_selector, count(*) AS archives FROM selection WHERE status = 'selected' GROUP BY ALL""")
def _(v: Views):
    return catalog.selector_counts(v.selection)


@query("worklist_skip_existing", "registry manifest", f"""
SELECT {FK}, version_selector
FROM (SELECT {FK}, n, CASE WHEN n = 0 THEN 'current' ELSE 'prev_' || n END AS version_selector
      FROM registry, range(13) r(n))
LEFT JOIN (SELECT {FK}, min(selector_no) AS gone FROM manifest WHERE status = '404' AND selector_no > 0 GROUP BY ALL)
  USING ({FK})
ANTI JOIN (SELECT {KEYS} FROM manifest WHERE status = '200') USING ({KEYS})
WHERE n = 0 OR gone IS NULL OR n < gone""")
def _(v: Views):
    return catalog.worklist_skip_existing(v.registry, v.manifest, 12)


def _halves(v: Views):
    """Two overlapping runs of the same manifest."""
    columns = [*A, "status", "bytes"]
    old = v.manifest.where("row_ix % 3 <> 0").select(*columns)
    new = v.manifest.where("row_ix % 5 < 3").withColumn("bytes", F.col("bytes") + 1).select(*columns)
    return old, new


@query("manifest_upsert", "manifest", f"""
SELECT {KEYS}, status, CASE WHEN row_ix % 5 < 3 THEN bytes + 1 ELSE bytes END AS bytes
FROM manifest WHERE row_ix % 3 <> 0 OR row_ix % 5 < 3""")
def _(v: Views):
    return catalog.manifest_upsert(*_halves(v))


@query("coverage_upsert", "coverage registry", f"""
SELECT {FK}, greatest(requested_history_depth, asked) AS requested_history_depth
FROM coverage FULL JOIN (SELECT {FK}, 6 AS asked FROM registry) USING ({FK})""")
def _(v: Views):
    return catalog.coverage_upsert(v.coverage, v.registry, 6)


@query("metadata_recovery_worklist", "manifest classified", f"""
SELECT {KEYS}, path FROM manifest SEMI JOIN (
  SELECT {KEYS} FROM classified WHERE classification IN ('latest_distinct_generation', 'timetable_content_changed'))
USING ({KEYS})
WHERE status = '200' AND selector_no > 0 AND content_disposition = ''""")
def _(v: Views):
    return catalog.metadata_recovery_worklist(v.manifest, v.classified).select(*A, "path")


def _answers(v: Views):
    """What a server could have answered for the older versions."""
    ix, size = F.col("row_ix"), F.col("bytes")
    told = F.when(ix % 6 == 0, size + 1).otherwise(size).cast("string")
    return v.manifest.where("version_selector <> 'current'").select(
        *A, "bytes",
        F.when(ix % 4 == 0, "206").when(ix % 4 == 1, "200").when(ix % 4 == 2, "404").alias("metadata_http_status"),
        F.when(ix % 5 == 0, "").otherwise(F.concat(F.lit('x; filename="n'), ix.cast("string"), F.lit('.zip"')))
        .alias("content_disposition"),
        F.when(ix % 4 == 0, F.concat(F.lit("bytes 0-0/"), told)).alias("content_range"),
        F.when(ix % 4 == 1, told).alias("content_length"),
        F.lit("2026-09-29").alias("metadata_retrieved_utc"), F.lit("range").alias("metadata_recovered_by"),
        F.when(ix % 4 == 2, "HTTP 404").otherwise("").alias("metadata_error"),
    )


ANSWERS = f"""(SELECT {KEYS}, bytes, row_ix,
  CASE row_ix % 4 WHEN 0 THEN '206' WHEN 1 THEN '200' WHEN 2 THEN '404' END AS metadata_http_status,
  CASE WHEN row_ix % 5 = 0 THEN '' ELSE 'x; filename="n' || row_ix || '.zip"' END AS new_disposition,
  CASE WHEN row_ix % 4 = 2 THEN 'HTTP 404' ELSE '' END AS metadata_error
  FROM manifest WHERE selector_no > 0)"""


@query("size_reconciliation", "manifest", f"""
SELECT {KEYS}, CASE WHEN metadata_http_status IS NULL OR metadata_http_status = '404' THEN 'bad_status'
  WHEN new_disposition = '' THEN 'no_disposition' WHEN row_ix % 6 = 0 THEN 'mismatch' ELSE 'ok' END AS size_status
FROM {ANSWERS}""")
def _(v: Views):
    return catalog.size_reconciliation(_answers(v)).select(*A, "size_status")


@query("metadata_merge", "manifest", f"""
SELECT {KEYS}, coalesce(nullif(new_disposition, ''), content_disposition) AS content_disposition,
       metadata_http_status, metadata_error
FROM manifest LEFT JOIN (SELECT {KEYS}, new_disposition, metadata_http_status, metadata_error FROM {ANSWERS}) USING ({KEYS})""")
def _(v: Views):
    return catalog.metadata_merge(v.manifest, _answers(v)).select(
        *A, "content_disposition", "metadata_http_status", "metadata_error"
    )


@query("metadata_recovery_log", "manifest", f"""
SELECT {KEYS}, m.source_url AS url, m.path, m.sha256, metadata_http_status, new_disposition AS content_disposition,
       '2026-09-29' AS retrieved_utc, metadata_error AS error
FROM (SELECT * FROM manifest WHERE content_disposition = '') m
JOIN (SELECT {KEYS}, new_disposition, metadata_http_status, metadata_error FROM {ANSWERS}) USING ({KEYS})""")
def _(v: Views):
    return catalog.metadata_recovery_log(v.manifest.where("content_disposition = ''"), _answers(v))


@query("fetch_run_counts", "manifest registry", f"""
SELECT (SELECT count(*) FROM registry) AS requested_feeds, count(*) AS records_written,
       count(*) FILTER (status = '200') AS zip_success,
       count(*) FILTER (status <> '200' AND selector_no > 0) AS history_empty_or_failed,
       (SELECT count(*) FROM registry WHERE {REASON} <> 'valid_on_anchor_date') AS excluded_from_current
FROM manifest""")
def _(v: Views):
    return catalog.fetch_run_counts(v.manifest, v.registry, catalog.excluded_feeds(v.registry, ANCHOR))


# -- digests ------------------------------------------------------------------

LINE = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_returnflag", "l_linestatus"]


def digest_sql(table: str, columns: list[str], keys: str = "") -> str:
    names = sorted(columns)
    header = "[" + ",".join(f'"{c}"' for c in names) + "]"
    cells = ", ".join(f"coalesce(CAST({c} AS VARCHAR), '')" for c in names)
    lead = f"{keys}, " if keys else ""
    return f"""
SELECT {lead}n_rows, sum_1, sum_2, sha256(concat_ws('|', '{header}', n_rows, sum_1, sum_2)) AS digest
FROM (SELECT {lead}count(*) AS n_rows,
             CAST(sum(CAST('0x' || substr(h, 1, 15) AS BIGINT)) AS VARCHAR) AS sum_1,
             CAST(sum(CAST('0x' || substr(h, 16, 15) AS BIGINT)) AS VARCHAR) AS sum_2
      FROM (SELECT {lead}sha256(CAST(to_json([{cells}]) AS VARCHAR)) AS h FROM {table}) GROUP BY ALL)"""


@query("table_digest", "", digest_sql("lineitem", LINE))
def _(v: Views):
    return digest.table_digest(v.table("lineitem").select(*LINE))


@query("table_digest_documents", "", digest_sql("documents", ["doc_id", "text", "lang"], "source"))
def _(v: Views):
    return digest.table_digest(v.table("documents"), ["source"], ["doc_id", "text", "lang"])


@query("validity_signature", "calendar", digest_sql("calendar", ["service_id", "start_date", "end_date"], K))
def _(v: Views):
    return digest.validity_signature(v.calendar)


def _members(v: Views):
    """The derived timetable as archive members."""
    def member(name: str, df, columns: dict[str, F.Column]):
        pairs = [x for c, e in columns.items() for x in (F.lit(c), e.cast("string"))]
        return df.select(
            *A, F.lit(name).alias("member"),
            F.array(*[F.lit(c) for c in columns]).alias("header"), F.create_map(*pairs).alias("row"),
        )

    col = F.col
    days = ["monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday"]
    flags = {d: F.get(col("flags"), F.lit(i)).cast("int") for i, d in enumerate(days)}
    parts = [
        member("routes.txt", v.routes, {c: col(c) for c in ("route_id", "agency_id", "route_type")}),
        member("trips.txt", v.trips, {c: col(c) for c in ("trip_id", "route_id", "service_id")}),
        member("stop_times.txt", v.stop_times,
               {c: col(c) for c in ("trip_id", "stop_id", "stop_sequence", "arrival_sec", "departure_sec")}),
        member("calendar.txt", v.calendar,
               {"service_id": col("service_id"), **flags, "start_date": col("start_date"), "end_date": col("end_date")}),
        member("calendar_dates.txt", v.calendar_dates,
               {c: col(c) for c in ("service_id", "date", "exception_type")}),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def signature_sql() -> str:
    def part(name: str, table: str, columns: list[str], expr: dict[str, str] | None = None, ordered=True) -> str:
        names = sorted(columns) if ordered else columns
        cells = ", ".join(f"coalesce(CAST({(expr or {}).get(c, c)} AS VARCHAR), '')" for c in names)
        header = "[" + ",".join(f'"{c}"' for c in names) + "]"
        return f"SELECT {K}, '{name}' AS part, '{header}' AS header, sha256(CAST(to_json([{cells}]) AS VARCHAR)) AS h FROM {table}"

    days = {d: "CAST(on_week AS INTEGER)" for d in ("monday", "tuesday", "wednesday", "thursday", "friday")}
    days |= {d: "CAST(on_weekend AS INTEGER)" for d in ("saturday", "sunday")}
    parts = " UNION ALL ".join([
        part("routes.txt", "routes", ["route_id", "agency_id", "route_type"]),
        part("trips.txt", "trips", ["trip_id", "route_id", "service_id"]),
        part("stop_times.txt", "stop_times", ["trip_id", "stop_id", "stop_sequence", "arrival_sec", "departure_sec"]),
        part("calendar_patterns", "calendar", ["service_id", *days], days, ordered=False),
        part("calendar_validity", "calendar", ["service_id", "start_date", "end_date"], ordered=False),
        part("calendar_exceptions", "calendar_dates", ["service_id", "date", "exception_type"], ordered=False),
    ])
    order = ["routes.txt", "trips.txt", "stop_times.txt", "calendar_patterns", "calendar_exceptions"]
    lines = ", ".join(f"'{p}:' || coalesce(max(digest) FILTER (part = '{p}'), 'MISSING')" for p in order)
    return f"""
SELECT {K}, sha256(concat_ws(chr(10), {lines})) AS timetable_signature,
       sha256(coalesce(max(digest) FILTER (part = 'calendar_validity'), 'MISSING')) AS validity_signature
FROM (SELECT {K}, part, sha256(concat_ws('|', header, count(*),
               CAST(sum(CAST('0x' || substr(h, 1, 15) AS BIGINT)) AS VARCHAR),
               CAST(sum(CAST('0x' || substr(h, 16, 15) AS BIGINT)) AS VARCHAR))) AS digest
      FROM ({parts}) GROUP BY {K}, part, header)
GROUP BY {K}"""


@query("timetable_signature", "routes trips stop_times calendar calendar_dates", signature_sql())
def _(v: Views):
    return digest.timetable_signature(digest.member_digests(_members(v)))


# -- history ------------------------------------------------------------------


@query("version_classify", "classified", f"""
SELECT {KEYS}, timetable_signature, validity_signature, sha256, effective_start, upload_utc,
       distinct_generation_number, classification FROM classified""")
def _(v: Views):
    return v.classified.select(
        *A, "timetable_signature", "validity_signature", "sha256", "effective_start", "upload_utc",
        "distinct_generation_number", "classification",
    )


@query("feed_history", "feed_states", "SELECT * FROM feed_states")
def _(v: Views):
    return history.feed_history(v.classified)


@query("version_representative", "representatives", f"""
SELECT {FK}, timetable_signature, version_selector, effective_start FROM representatives""")
def _(v: Views):
    return history.version_representative(v.classified)


@query("history_exhaustion", "exhaustion", "SELECT * FROM exhaustion")
def _(v: Views):
    return history.history_exhaustion(v.manifest, v.coverage)


@query("operator_history", "operator_history", "SELECT * FROM operator_history")
def _(v: Views):
    return operator_history(v)


def operator_history(v: Views):
    return history.operator_history(
        v.component_feeds, v.version_metrics, history.version_representative(v.classified),
        history.feed_history(v.classified), history.history_exhaustion(v.manifest, v.coverage),
    )


@query("operator_history_simple", "component_feeds feed_states", f"""
SELECT operator_id, current_feed_count, history_feed_rows_found, measured AS all_component_feeds_measured,
       lo AS distinct_generations_min_across_feeds, coalesce(measured AND lo = 1 AND hi = 1, false) AS current_only_all_feeds,
       coalesce(measured AND lo >= 2, false) AS generations_2plus_all_feeds,
       measured AND y1 AS years_1plus_all_feeds, measured AND y2 AS years_2plus_all_feeds,
       measured AND y3 AS years_3plus_all_feeds, span AS minimum_component_history_span_days,
       CASE WHEN measured THEN 'measured' ELSE 'incomplete_component_feed_history' END AS history_status
FROM (SELECT operator_id, count(*) AS current_feed_count, count(distinct_timetable_generations) AS history_feed_rows_found,
             count(*) = count(distinct_timetable_generations) AS measured,
             min(distinct_timetable_generations) AS lo, max(distinct_timetable_generations) AS hi,
             bool_and(coalesce(history_1plus_year, false)) AS y1, bool_and(coalesce(history_2plus_year, false)) AS y2,
             bool_and(coalesce(history_3plus_year, false)) AS y3, min(history_span_days) AS span
      FROM component_feeds LEFT JOIN feed_states USING ({FK}) GROUP BY operator_id)""")
def _(v: Views):
    return history.operator_history_simple(v.component_feeds, history.feed_history(v.classified))


@query("yoy_interval_pair", "yoy_pairs", "SELECT * FROM yoy_pairs")
def _(v: Views):
    return history.yoy_interval_pair(v.version_metrics)


@query("supply_yoy", "supply_yoy", "SELECT * FROM supply_yoy")
def _(v: Views):
    return history.supply_yoy(v.component_feeds, history.yoy_interval_pair(v.version_metrics))


@query("operator_component_feeds", "version_metrics", f"""
SELECT operator_id, {FK} FROM version_metrics GROUP BY ALL""")
def _(v: Views):
    return service.operator_component_feeds(v.version_metrics)
