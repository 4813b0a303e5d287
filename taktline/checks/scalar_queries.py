"""Column functions over whole given tables."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from taktline import functions as fn
from taktline.checks.links_views import LinksViews as Views, sql_norm
from taktline.checks.registry import query
from taktline.constants import ARCHIVE_KEYS
from taktline.operators import links

A = list(ARCHIVE_KEYS)
KEYS = ", ".join(A)


def pick(number: Column, *texts: Column | str | None) -> Column:
    """Text by the remainder of a number."""
    out = None
    for i, t in enumerate(texts):
        value = F.lit(t) if t is None or isinstance(t, str) else t
        out = F.when(number % len(texts) == i, value) if out is None else out.when(number % len(texts) == i, value)
    return out


def date_texts() -> Column:
    d = F.col("o_orderdate")
    unpadded = F.concat_ws("-", F.year(d).cast("string"), F.month(d).cast("string"), F.day(d).cast("string"))
    return pick(
        F.col("o_orderkey"), F.date_format(d, "yyyy-MM-dd"), F.date_format(d, "yyyyMMdd"),
        F.date_format(d, " yyyy/MM/dd "), "x", unpadded, F.date_format(d, "dd.MM.yyyy"), None,
    )


@query("parse_date3", "", """
SELECT o_orderkey, CASE WHEN o_orderkey % 7 IN (0, 1, 2, 4) THEN CAST(o_orderdate AS DATE) END AS d FROM orders""")
def _(v: Views):
    return v.table("orders").select("o_orderkey", fn.parse_date3(date_texts()).alias("d"))


@query("parse_date2", "", """
SELECT o_orderkey, CASE WHEN o_orderkey % 7 IN (0, 1, 4) THEN CAST(o_orderdate AS DATE) END AS d FROM orders""")
def _(v: Views):
    return v.table("orders").select("o_orderkey", fn.parse_date2(date_texts()).alias("d"))


SLUG = "coalesce(nullif(trim(regexp_replace({c}, '[^0-9A-Za-z._-]+', '_', 'g'), '._'), ''), 'blank')"


@query("safe_slug", "", f"SELECT page_id, {SLUG.format(c='url')} AS slug FROM pages")
def _(v: Views):
    return v.table("pages").select("page_id", fn.safe_slug(F.col("url")).alias("slug"))


@query("slug_pair", "", f"""
SELECT p_partkey, {SLUG.format(c='p_brand')} || '__' || {SLUG.format(c="CASE WHEN p_partkey % 9 = 0 THEN '..#' ELSE p_name END")} AS pair FROM part""")
def _(v: Views):
    feed = F.when(F.col("p_partkey") % 9 == 0, "..#").otherwise(F.col("p_name"))
    return v.table("part").select("p_partkey", fn.slug_pair(F.col("p_brand"), feed).alias("pair"))


@query("num", "", """
SELECT p_partkey, CAST(CASE p_partkey % 4 WHEN 0 THEN p_size WHEN 1 THEN -p_size END AS INTEGER) AS n FROM part""")
def _(v: Views):
    size = F.col("p_size").cast("string")
    text = pick(F.col("p_partkey"), F.concat(F.lit(" "), size, F.lit("\t")), F.concat(F.lit("-"), size),
                F.concat(size, F.lit(".0")), F.col("p_name"))
    return v.table("part").select("p_partkey", fn.num(text).alias("n"))


def clock() -> Column:
    o = F.col("o_orderkey")
    hm = F.concat_ws(":", (o % 30).cast("string"), F.lpad((o % 60).cast("string"), 2, "0"))
    return F.when(o % 11 == 0, hm).when(o % 11 == 1, "x:00:00").otherwise(F.concat(hm, F.lit(":05 ")))


CLOCK = """CASE WHEN o_orderkey % 11 > 1 THEN (o_orderkey % 30) * 3600 + (o_orderkey % 60) * 60 + 5 END"""


@query("gtfs_seconds", "", f"SELECT o_orderkey, {CLOCK} AS sec FROM orders")
def _(v: Views):
    return v.table("orders").select("o_orderkey", fn.gtfs_seconds(clock()).alias("sec"))


@query("fmt_time", "", """
SELECT o_orderkey, CASE WHEN o_orderkey % 11 > 1 THEN lpad(CAST(o_orderkey % 30 AS VARCHAR), 2, '0') || ':'
  || lpad(CAST(o_orderkey % 60 AS VARCHAR), 2, '0') ELSE '' END AS shown FROM orders""")
def _(v: Views):
    return v.table("orders").select("o_orderkey", fn.fmt_time(fn.gtfs_seconds(clock())).alias("shown"))


@query("haversine_km", "", """
SELECT o_orderkey, CASE WHEN o_orderkey % 10 > 0 THEN round(6371.0088 * 2 * asin(least(1.0, sqrt(
  power(sin((radians(b) - radians(a)) / 2), 2)
  + cos(radians(a)) * cos(radians(b)) * power(sin((radians(d) - radians(c)) / 2), 2)))), 6) END AS km
FROM (SELECT o_orderkey, (o_orderkey % 180)::DOUBLE - 90 AS a, (o_orderkey % 171)::DOUBLE - 85 AS b,
             (o_orderkey % 360)::DOUBLE - 180 AS c, (o_orderkey % 323)::DOUBLE - 160 AS d FROM orders)""")
def _(v: Views):
    o = F.col("o_orderkey")
    lat1 = F.when(o % 10 > 0, (o % 180).cast("double") - 90)
    km = fn.haversine_km(
        lat1, (o % 360).cast("double") - 180, (o % 171).cast("double") - 85, (o % 323).cast("double") - 160
    )
    return v.table("orders").select("o_orderkey", F.round(km, 6).alias("km"))


@query("is_bus_route", "", """
SELECT p_partkey, p_partkey % 5 <> 4 AND (p_partkey % 900 IN (3, 11) OR p_partkey % 900 BETWEEN 700 AND 799) AS bus FROM part""")
def _(v: Views):
    p = F.col("p_partkey")
    code = F.when(p % 5 == 4, F.concat(F.lit("t"), (p % 900).cast("string"))).otherwise((p % 900).cast("string"))
    return v.table("part").select("p_partkey", fn.is_bus_route(code).alias("bus"))


@query("canonical_operator", "agency_records", "SELECT agency_id, operator_identity_key FROM agency_records")
def _(v: Views):
    return v.agency_records.select("agency_id", "operator_identity_key")


@query("operator_id", "agency_records", "SELECT agency_id, operator_id FROM agency_records")
def _(v: Views):
    return v.agency_records.select("agency_id", "operator_id")


@query("links_operator_id", "links_rows", "SELECT source_file, source_row, links_operator_id FROM links_rows")
def _(v: Views):
    return v.links_rows.select("source_file", "source_row", "links_operator_id")


@query("selector_no", "manifest", f"""
SELECT {KEYS}, CAST(CASE WHEN row_ix % 41 = 0 THEN 999 ELSE selector_no END AS INTEGER) AS n FROM manifest""")
def _(v: Views):
    told = F.when(F.col("row_ix") % 41 != 0, F.col("version_selector"))
    return v.manifest.select(*A, fn.selector_no(told).alias("n"))


@query("disposition_filename", "manifest", f"""
SELECT {KEYS}, CASE WHEN content_disposition = '' THEN 'feed' || substr(feed_id, 5) || '__' || version_selector || '.zip'
  ELSE split_part(content_disposition, '"', 2) END AS file_name FROM manifest""")
def _(v: Views):
    name = fn.disposition_filename(F.col("content_disposition"), F.col("path"))
    return v.manifest.select(*A, name.alias("file_name"))


@query("upload_datetime", "manifest", f"SELECT {KEYS}, upload_utc FROM manifest")
def _(v: Views):
    return v.manifest.select(*A, "upload_utc")


@query("effective_date", "manifest", f"SELECT {KEYS}, effective_start FROM manifest")
def _(v: Views):
    return v.manifest.select(*A, "effective_start")


@query("classify_dataset", "", """
SELECT p_partkey, CASE WHEN p_partkey % 7 IN (0, 1, 2) THEN 'business_overview' WHEN p_partkey % 7 IN (3, 4) THEN 'transport_performance'
  WHEN p_partkey % 7 = 5 THEN 'specification' ELSE 'other' END AS dataset FROM part""")
def _(v: Views):
    tail = F.concat(F.col("p_name"), F.lit(".csv"))
    name = pick(F.col("p_partkey"), F.concat(F.lit("JigyouGaiyou_"), tail), F.concat(F.lit("輸送実績と概況"), tail),
                F.concat(F.lit("BusReport"), tail), F.concat(F.lit("輸送実績"), tail),
                F.concat(F.lit("Transport-"), tail), F.concat(F.lit("仕様書"), tail), tail)
    return v.table("part").select("p_partkey", fn.classify_dataset(name).alias("dataset"))


@query("has_value", "", "SELECT c_custkey, c_custkey % 10 >= 8 AS valued FROM customer")
def _(v: Views):
    text = pick(F.col("c_custkey"), "", " ", "-", "－", "NA", "N/A", "null ", None, "0", F.col("c_name"))
    return v.table("customer").select("c_custkey", fn.has_value(text).alias("valued"))


@query("infer_year", "", r"""
SELECT doc_id, regexp_extract(text || n_chars, '((?:19|20)\d{2})', 1) AS year FROM documents""")
def _(v: Views):
    text = F.concat(F.col("text"), F.col("n_chars").cast("string"))
    return v.table("documents").select("doc_id", fn.infer_year(text).alias("year"))


@query("truth", "", "SELECT c_custkey, c_custkey % 8 < 4 AS yes FROM customer")
def _(v: Views):
    text = pick(F.col("c_custkey"), "True", " 1", "YES", "y ", "False", "0", "", None)
    return v.table("customer").select("c_custkey", fn.truth(text).alias("yes"))


@query("pick_column", "links_rows", """
SELECT source_file, source_row, '事業者名' AS operator_name, '事業者番号' AS operator_number,
       CASE WHEN source_file LIKE '%3.csv' THEN NULL ELSE '対象年度' END AS year, '事業区分' AS permit_type,
       '住所' AS prefecture_address FROM links_rows""")
def _(v: Views):
    picked = links.pick_column(F.col("columns"))
    return v.records.select("source_file", "source_row", *[c.alias(n) for n, c in picked.items()])


@query("multi_value_cell", "links_rows", """
SELECT source_file, source_row, operator_name || '|' || operator_number AS cell FROM links_rows""")
def _(v: Views):
    columns = links.map_fields(F.col("columns"))["operator_name"]
    return v.records.select("source_file", "source_row", links.multi_value_cell(columns, F.col("row")).alias("cell"))


@query("prefixed_passthrough", "links_rows", """
SELECT source_file, source_row, CASE WHEN source_file LIKE '%3.csv' THEN 8 ELSE 10 END AS fields,
       permit_type, prefecture_address FROM links_rows""")
def _(v: Views):
    row = links.prefixed_passthrough(F.col("row"))
    return v.records.select(
        "source_file", "source_row", F.size(row).alias("fields"), row["field_事業区分"].alias("permit_type"),
        row["field_住所"].alias("prefecture_address"),
    )


@query("split_pairs", "agency_records", """
SELECT operator_id, organization_id, feed_id FROM agency_records GROUP BY ALL""")
def _(v: Views):
    pairs = fn.split_pairs(F.col("organization_feed_pairs"))
    return v.operators.select("operator_id", F.inline(pairs))


@query("name_signals", "", """
SELECT p_partkey, p_partkey % 5 IN (0, 1) AS municipal_suffix, p_partkey % 5 = 2 AS council_name,
       p_partkey % 5 = 3 AS iyo_rail_check FROM part""")
def _(v: Views):
    p = F.col("p_name")
    name = pick(F.col("p_partkey"), F.concat(p, F.lit("市")), F.concat(p, F.lit("村")), F.concat(p, F.lit("協議会バス")),
                F.concat(F.lit("伊予鉄"), p), F.concat(F.lit("市"), p))
    return v.table("part").select("p_partkey", *[c.alias(n) for n, c in fn.name_signals(name).items()])


@query("safe_rate", "", "SELECT p_partkey, round(p_size / nullif(p_partkey % 7, 0)::DOUBLE, 4) AS rate FROM part")
def _(v: Views):
    return v.table("part").select("p_partkey", fn.safe_rate(F.col("p_size"), F.col("p_partkey") % 7).alias("rate"))


@query("pct_change", "", """
SELECT p_partkey, round((p_size - p_partkey % 7) / nullif(p_partkey % 7, 0)::DOUBLE * 100, 3) AS pct FROM part""")
def _(v: Views):
    return v.table("part").select("p_partkey", fn.pct_change(F.col("p_size"), F.col("p_partkey") % 7).alias("pct"))


@query("legal_form_sequence", "", f"""
SELECT p_partkey, {sql_norm("'(株' || p_name || '式会社)' || '株式会社'")} AS key FROM part""")
def _(v: Views):
    name = F.concat(F.lit("(株"), F.col("p_name"), F.lit("式会社)"), F.lit("株式会社"))
    return v.table("part").select("p_partkey", fn.normalize_name(name).alias("key"))
