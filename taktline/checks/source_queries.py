"""Readers and writers over content made from the given tables."""

from __future__ import annotations

import io
import zipfile

import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from taktline.checks.catalog_views import ANCHOR
from taktline.checks.catalog_queries import digest_sql
from taktline.checks.links_views import LinksViews as Views
from taktline.checks.oracle_views import K, VIEWS, compose
from taktline.checks.registry import ORACLES, query
from taktline.checks.views import text
from taktline.constants import ARCHIVE_KEYS
from taktline.plans.history import version_metrics
from taktline.schemas import LINKS_OPERATORS, LINKS_ROWS
from taktline.sources import archives as src, csv_ranges, lists, members, registry as reg, tables

A = list(ARCHIVE_KEYS)


@F.pandas_udf(BinaryType())
def zipped(member: pd.Series, body: pd.Series) -> pd.Series:
    """A ZIP file with one member, to have something to read."""
    def one(name: str, content: str) -> bytes:
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as archive:
            archive.writestr(name, b"\xef\xbb\xbf" + content.encode("utf-8"))
        return out.getvalue()

    return pd.Series([one(m, b) for m, b in zip(member, body)], dtype=object)


REGISTRY = """SELECT organization_id, feed_id, feed_pref_id, latest_feed_start_date, latest_feed_end_date,
  feed_is_discontinued, feed_discontinued_date FROM registry"""
REGISTRY_COLUMNS = ["organization_id", "feed_id", "feed_pref_id", "latest_feed_start_date", "latest_feed_end_date",
                    "feed_is_discontinued", "feed_discontinued_date"]


def _envelopes(v: Views):
    """Catalogue documents of at most ten feeds each."""
    feeds = v.registry.withColumn("no", F.floor(F.substring("feed_id", 5, 18).cast("bigint") / 10))
    body = F.collect_list(F.struct(*REGISTRY_COLUMNS, F.lit("x@example.jp").alias("organization_email")))
    return feeds.groupBy("no").agg(F.to_json(F.struct(F.lit(200).alias("code"), body.alias("body"))).alias("value"))


@query("src_registry_json", "registry", REGISTRY)
def _(v: Views):
    return reg.parse_registry(_envelopes(v)).select(*REGISTRY_COLUMNS)


@query("registry_counts", "registry", """
SELECT count(*) AS records, count(DISTINCT (organization_id, feed_id)) AS feed_pairs,
       count(DISTINCT organization_id) AS publishers FROM registry""")
def _(v: Views):
    return reg.registry_counts(v.registry)


@query("registry_redact", "registry", digest_sql("registry", REGISTRY_COLUMNS))
def _(v: Views):
    return reg.redaction_summary(v.registry.withColumn("organization_email", F.col("feed_id")))


@query("src_feed_pairs", "", """
SELECT DISTINCT 'org' || (c_custkey % 5) AS organization_id, 'feed' || (c_custkey % 100) AS feed_id
FROM customer WHERE c_custkey % 7 <> 0""")
def _(v: Views):
    c = F.col("c_custkey")
    line = F.when(c % 7 == 0, "no pair").otherwise(F.concat(text("org", c % 5), F.lit(" , "), text("feed", c % 100)))
    return lists.parse_feed_pairs(v.table("customer").select(line.alias("value")))


@query("sink_feed_pairs", "agency_records", """
SELECT DISTINCT organization_id || ',' || feed_id AS value FROM agency_records""")
def _(v: Views):
    path = f"{v.workspace.folder}/feed_pairs"
    lists.write_feed_pairs(v.agency_records, path)
    pairs = lists.read_feed_pairs(v.spark, path)
    return pairs.select(F.concat_ws(",", "organization_id", "feed_id").alias("value"))


@query("archive_digest", "", """
SELECT 'd' || doc_id AS path, sha256(text) AS sha256, octet_length(encode(text)) AS bytes FROM documents""")
def _(v: Views):
    files = v.table("documents").select(text("d", "doc_id").alias("path"), F.encode("text", "UTF-8").alias("content"))
    return src.archive_digest(files)


@query("payload_sniff", "", """
SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'rejected_html' WHEN doc_id % 5 = 0 THEN 'zip' WHEN doc_id % 4 = 1 THEN 'csv'
  WHEN regexp_matches(substr(hex(encode(text)), 1, 8192), '^(?:..)*2C') THEN 'csv' ELSE 'bin' END AS payload
FROM documents""")
def _(v: Views):
    d = F.col("doc_id")
    body = F.encode("text", "UTF-8")
    content = F.when(d % 5 == 0, F.concat(F.unhex(F.lit("504B0304")), body)).otherwise(body)
    kind = F.when(d % 4 == 0, "text/HTML").when(d % 4 == 1, "text/csv").when(d % 4 == 2, "")
    return v.table("documents").select("doc_id", src.payload_sniff(content, kind).alias("payload"))


@query("src_archive_members", "agency", f"""
SELECT {K}, agency_id, agency_name, agency_url, CAST(1 AS BIGINT) AS row_ix FROM agency""")
def _(v: Views):
    quoted = [F.concat(F.lit('"'), c, F.lit('"')) for c in ("agency_id", "agency_name", "agency_url")]
    body = F.concat(F.lit("agency_id,agency_name,agency_url\r\n"), F.concat_ws(",", *quoted), F.lit("\r\n"))
    files = v.agency.select(*A, F.concat(text("z", "row_ix"), F.lit(".zip")).alias("path"),
                            zipped(F.lit("AGENCY.txt"), body).alias("content"))
    return src.agency_table(src.with_archive_keys(src.unzip_members(files), files))


@query("src_links_records", "", """
SELECT CASE WHEN c_custkey % 2 = 0 THEN 'sub/transport' ELSE 'busreport' END || c_custkey || '.csv' AS source_file,
       CASE WHEN c_custkey % 2 = 0 THEN 'transport_performance' ELSE 'business_overview' END AS dataset,
       CAST(1 AS BIGINT) AS source_row, '事業者名|年度' AS columns, c_name AS name, c_mktsegment AS year FROM customer""")
def _(v: Views):
    c = F.col("c_custkey")
    even = c % 2 == 0
    name = F.concat(F.when(even, "sub/transport").otherwise("busreport"), c.cast("string"), F.lit(".csv"))
    body = F.concat(F.lit("事業者名,年度\n"), F.col("c_name"), F.lit(","), F.col("c_mktsegment"), F.lit("\n"))
    files = v.table("customer").select(
        F.when(even, F.concat(text("f", c), F.lit(".zip"))).otherwise(F.concat(F.lit("x/"), name)).alias("path"),
        F.when(even, zipped(name, body)).otherwise(F.encode(body, "UTF-8")).alias("content"),
    )
    records = src.links_records(files).where("row IS NOT NULL")
    return records.select("source_file", "dataset", "source_row", F.array_join("columns", "|").alias("columns"),
                          F.col("row")["事業者名"].alias("name"), F.col("row")["年度"].alias("year"))


@query("src_links_files", "", """
SELECT c_name AS name, CAST(c_custkey AS VARCHAR) AS number, c_mktsegment AS permit FROM customer""")
def _(v: Views):
    path = f"{v.workspace.folder}/links_files"
    v.table("customer").select(
        F.col("c_name").alias("事業者名"), F.col("c_custkey").alias("事業者番号"), F.col("c_mktsegment").alias("事業区分")
    ).write.csv(path, header=True)
    row = F.col("row")
    return src.links_records(src.links_files(v.spark, path)).where("row IS NOT NULL").select(
        row["事業者名"].alias("name"), row["事業者番号"].alias("number"), row["事業区分"].alias("permit")
    )


@query("src_csv_table", "", """
SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, 'a, "b" ' || c_name AS c_name,
       CASE WHEN c_custkey % 3 = 0 THEN '' ELSE c_mktsegment END AS c_mktsegment FROM customer""")
def _(v: Views):
    rows = v.table("customer").select(
        F.col("c_custkey").cast("string").alias("c_custkey"), F.concat(F.lit('a, "b" '), "c_name").alias("c_name"),
        F.when(F.col("c_custkey") % 3 != 0, F.col("c_mktsegment")).alias("c_mktsegment"),
    )
    path = f"{v.workspace.folder}/customer_csv"
    rows.write.option("escape", '"').csv(path, header=True)
    return tables.read_csv(v.spark, path)


@query("sink_table", "", """
SELECT c_custkey AS id, c_name AS name, CAST(NULL AS INTEGER) AS nation FROM customer
UNION ALL SELECT s_suppkey, s_name, s_nationkey FROM supplier""")
def _(v: Views):
    a = v.table("customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    b = v.table("supplier").select(F.col("s_nationkey").alias("nation"), F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))
    path = f"{v.workspace.folder}/both"
    tables.write_table(tables.union_tables([a, b]), path)
    return v.spark.read.parquet(path)


@query("fetch_status_log", "", """
SELECT event_type AS status, count(*) AS attempts FROM events GROUP BY event_type
UNION ALL SELECT r_name, count(*) FROM region GROUP BY r_name""")
def _(v: Views):
    folder = v.workspace.folder
    v.table("events").select(F.col("user_id").cast("string").alias("url"), F.col("event_type").alias("status")).write.csv(f"{folder}/log_csv", header=True)
    # The JSON form of the log is one document; the five regions make one.
    document = v.table("region").agg(F.to_json(F.collect_list(F.struct(F.col("r_name").alias("status"), F.col("r_regionkey").cast("string").alias("reason")))).alias("value"))
    document.write.text(f"{folder}/log_json")
    return tables.status_counts(tables.fetch_status_log(v.spark, f"{folder}/log_csv", f"{folder}/log_json"))


@query("sink_run_metadata", "selection agency_records operators", """
SELECT '2020-06-25' AS anchor_date, sum(n)::BIGINT AS selected_anchor_feed_archives,
       string_agg(selected_version_selector || '=' || n, '|' ORDER BY selected_version_selector) AS selectors,
       (SELECT count(*) FROM agency_records) AS bus_agency_rows, (SELECT count(*) FROM operators) AS gtfs_bus_operator_entities,
       (SELECT count(*) FROM selection WHERE status = 'selected' AND CAST(substr(feed_id, 5) AS BIGINT) % 6 = 0) AS excluded_feeds,
       CAST(0 AS BIGINT) AS errors, '3, 11, 700-799' AS route_type_rule
FROM (SELECT selected_version_selector, count(*) AS n FROM selection WHERE status = 'selected' GROUP BY 1)""")
def _(v: Views):
    errors = v.agency_records.where("false").select("feed_id")
    one = tables.run_metadata(ANCHOR, v.selection, v.feed_states, v.agency_records, v.operators, errors)
    entries = F.transform(
        F.map_entries("selected_archive_versions"),
        lambda e: F.concat_ws("=", e["key"], e["value"].cast("string")),
    )
    return one.select("*", F.array_join(entries, "|").alias("selectors")).drop("selected_archive_versions")


# -- several versions of a feed in one job ------------------------------------


class TwoVersions(Views):
    """Two archives per feed, the older one with fewer trips."""

    @property
    def _supplier_feed(self):
        both = F.explode(F.array(F.lit("current"), F.lit("prev_1")))
        return super()._supplier_feed.drop("version_selector").select("*", both.alias("version_selector"))

    def _doubled(self, df):
        both = F.explode(F.array(F.lit("current"), F.lit("prev_1")))
        return df.drop("version_selector").select("*", both.alias("version_selector"))

    @property
    def trips(self):
        return super().trips.where("version_selector = 'current' OR row_ix % 3 <> 0")

    @property
    def calendar(self):
        return self._doubled(super().calendar)

    @property
    def calendar_dates(self):
        return self._doubled(super().calendar_dates)

    @property
    def feed_info(self):
        return self._doubled(super().feed_info)

    @property
    def generations(self):
        current = F.col("version_selector") == "current"
        return self._doubled(self.archives).select(
            *A, F.when(current, F.col("anchor_date")).otherwise(F.date_sub("anchor_date", 90)).alias("effective_start"),
            F.when(current, 1).otherwise(2).alias("distinct_generation_number"),
            F.concat_ws("-", "feed_id", "version_selector").alias("timetable_signature"),
        )


def _doubled_sql(name: str) -> str:
    return VIEWS[name][1].replace("'current' AS version_selector", "unnest(['current', 'prev_1']) AS version_selector")


VERSION_SQL = compose(
    "agency_metrics",
    "SELECT * EXCLUDE (source_zip, source_zip_sha256, anchor_date), anchor_date AS generation_effective_start, "
    "feed_id || '-' || version_selector AS timetable_signature FROM agency_metrics",
    {
        **{n: _doubled_sql(n) for n in ("supplier_feed", "calendar", "calendar_dates", "feed_info")},
        "archives": f"""SELECT {K}, CASE WHEN version_selector = 'current' THEN anchor_date ELSE anchor_date - 90 END AS anchor_date,
  source_zip, source_zip_sha256 FROM ({_doubled_sql('archives')})""",
        "trips": f"SELECT * FROM ({VIEWS['trips'][1]}) WHERE version_selector = 'current' OR row_ix % 3 <> 0",
    },
)


@query("version_metrics")
def _(v: Views):
    two = TwoVersions(v.spark, v.sf_dir)
    return version_metrics(two.generations, two, v.feeds, v.workspace)


ORACLES["version_metrics"] = VERSION_SQL


# -- archives that fail --------------------------------------------------------


STOP_TIMES = 100  # rows of stop_times.txt in each archive


@F.pandas_udf(BinaryType())
def feeds_zipped(orders: pd.Series) -> pd.Series:
    """Archives with several members and rows; some damaged in the middle, some with a member twice."""
    import functools
    import zlib

    times = "trip_id,stop_sequence\n" + "".join(f"t{i},{zlib.crc32(bytes([i % 256]))}\n" for i in range(STOP_TIMES))

    @functools.cache
    def made(routes: int, twice: bool, damaged: bool, cut: bool) -> bytes:
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as archive:
            archive.writestr("Routes.TXT", "route_id,route_type\n" + "".join(f"r{i},3\n" for i in range(routes)))
            if twice:
                archive.writestr("routes.txt", "route_id,route_type\nother,3\n")
            archive.writestr("stop_times.txt", times)
            archive.writestr("notes.csv", "x\n1\n")
        data = bytearray(out.getvalue())
        if damaged:  # the last third of the stop times does not unpack
            at = data.rindex(b"notes.csv", 0, data.rindex(b"PK\x01\x02")) - 200
            data[at : at + 60] = bytes(60)
        return bytes(data[: len(data) // 2] if cut else data)

    return pd.Series([made(k % 4, k % 5 == 0, k % 7 == 0, k % 11 == 0) for k in orders], dtype=object)


def _feeds(v: Views):
    key = F.col("o_orderkey")
    return v.spread("orders", "o_orderkey").select(
        F.lit("o").alias("organization_id"), text("f", key).alias("feed_id"), F.lit("current").alias("version_selector"),
        F.concat(F.lit("file:///data/"), text("f", key), F.lit(".zip")).alias("path"), feeds_zipped(key).alias("content"))


@query("archive_errors", "", """
SELECT 'f' || o_orderkey AS feed_id, o_orderkey % 7 = 0 OR o_orderkey % 11 = 0 AS failed FROM orders
WHERE o_orderkey % 7 = 0 OR o_orderkey % 11 = 0""")
def _(v: Views):
    _, errors = src.split_errors(src.unzip_members(_feeds(v)))
    return errors.select("feed_id", F.col("error").isNotNull().alias("failed"))


@query("archive_rows_complete", "", """
SELECT 'f' || o_orderkey AS feed_id, o_orderkey % 4 AS routes, CAST(100 AS BIGINT) AS stop_times FROM orders
WHERE o_orderkey % 7 <> 0 AND o_orderkey % 11 <> 0""")
def _(v: Views):
    path = f"{v.workspace.folder}/members"
    src.write_members(src.unzip_members(_feeds(v)), path)
    rows, _ = src.split_errors(v.spark.read.parquet(path))
    given = rows.where("row IS NOT NULL")
    return rows.select("feed_id").distinct().join(given.groupBy("feed_id").agg(
        F.count_if(F.col("member") == "routes.txt").alias("routes"), F.count_if(F.col("member") == "stop_times.txt").alias("stop_times")), "feed_id")


@query("archive_keys_by_path", "", """
SELECT 'f' || o_orderkey AS feed_id, 'k' || o_orderkey AS key FROM orders WHERE o_orderkey % 3 <> 0
UNION ALL SELECT 'f' || o_orderkey, NULL FROM orders WHERE o_orderkey % 3 = 0""")
def _(v: Views):
    key = F.col("o_orderkey")
    orders = v.table("orders")
    name = F.concat(text("f", key), F.lit(".zip"))
    files = orders.select(F.concat(F.lit("file:///srv/data/"), name).alias("path"))
    listed = orders.where("o_orderkey % 3 <> 0").select(
        F.lit("o").alias("organization_id"), text("k", key).alias("feed_id"), F.lit("current").alias("version_selector"),
        F.concat(F.when(key % 2 == 0, "data\\").otherwise("./data//"), name).alias("path"))
    feed = F.regexp_extract("path", "(f[0-9]+)[.]zip", 1)
    return src.keyed_files(files, listed).select(feed.alias("feed_id"), F.col("feed_id").alias("key")).unionByName(
        src.unlisted_files(files, listed).select(feed.alias("feed_id"), F.lit(None).cast("string").alias("key")))


@query("links_file_status", "", """
SELECT 'f' || c_custkey AS name, CASE c_custkey % 5 WHEN 0 THEN 'spreadsheet_not_decoded' WHEN 1 THEN 'unreadable'
  WHEN 2 THEN 'no_csv_member' ELSE 'read' END AS status, CASE WHEN c_custkey % 5 >= 3 THEN CAST(1 AS BIGINT) END AS rows FROM customer""")
def _(v: Views):
    c = F.col("c_custkey")
    body = F.concat(F.lit("事業者名\n"), F.col("c_name"), F.lit("\n"))
    files = v.table("customer").select(
        F.concat(F.lit("/in/"), text("f", c), F.when(c % 5 == 0, ".XLSX").when(c % 5 == 4, ".csv").otherwise(".zip")).alias("path"),
        F.when(c % 5 == 1, F.encode(F.lit("PK no archive"), "UTF-8")).when(c % 5 == 2, zipped(F.lit("readme.txt"), body))
        .when(c % 5 == 3, zipped(F.lit("report.csv"), body)).otherwise(F.encode(body, "UTF-8")).alias("content"))
    return src.links_status(files).select(F.regexp_extract("path", "(f[0-9]+)[.]", 1).alias("name"), "status", "rows")


# -- archives that are read member by member -------------------------------------

ARCHIVE_ORDERS = 1000  # order keys in one archive


def _zip_orders(group: pa.Table) -> pa.Table:
    """One archive of the orders in a range of keys; a seventh of them is cut off in the middle."""
    no = group.column("no")[0].as_py()
    trips = sorted(zip(group.column("o_orderkey").to_pylist(), group.column("o_custkey").to_pylist()))
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as archive:
        archive.writestr("Trips.txt", "trip_id,note,route_id,service_id\n" + "".join(f't{o},"a, ""b""\n",r{c},f{no}\n' for o, c in trips))
        archive.writestr("stop_times.txt", "trip_id,stop_sequence,arrival_time\n" + "".join(f"t{o},{i},8:0{i}:00\n" for o, _ in trips for i in range(3)))
    data = out.getvalue()
    return pa.table({"value": pa.array([data[: len(data) // 2] if no % 7 == 0 else data], pa.binary())})


FILE_ORDERS = 1_000_000  # order rows in one file


def _in_files(orders, rows: int = FILE_ORDERS):
    """Orders in files that follow one another by key: a file is sorted by one task."""
    return orders.repartitionByRange(max(1, -(-orders.count() // rows)), "o_orderkey").sortWithinPartitions("o_orderkey")


def _numbered_on(records, status):
    """Records with their numbers carried on from file to file, by the order of the paths."""
    before = F.expr("sum(rows) OVER (ORDER BY path ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)")
    offsets = status.select("path", F.coalesce(before, F.lit(0)).alias("before"))
    return records.join(F.broadcast(offsets), "path").withColumn("source_row", F.col("source_row") + F.col("before"))


@query("src_links_ranges", "", """
SELECT 'transport_performance' AS dataset, 'order' || o_orderkey AS name, 'a, "b"' || chr(10) || o_orderpriority AS permit,
       row_number() OVER (ORDER BY o_orderkey) AS source_row FROM orders""")
def _(v: Views):
    folder = f"{v.workspace.folder}/transport"
    _in_files(v.table("orders")).select(
        text("order", "o_orderkey").alias("事業者名"), F.concat(F.lit('a, "b"\n'), "o_orderpriority").alias("事業区分"),
    ).write.option("escape", '"').csv(folder, header=True)
    row = F.col("row")
    # Records hold line ends, and ranges are short, so that most begin within a record.
    found = csv_ranges.Statistics(v.spark, folder, v.workspace, range_bytes=1 << 16)
    return _numbered_on(found.records().where("row IS NOT NULL"), found.status()).select(
        F.lit("transport_performance").alias("dataset"), row["事業者名"].alias("name"), row["事業区分"].alias("permit"), "source_row")


def _order_archives(v: Views) -> str:
    """A folder of archives made of all orders."""
    folder = f"{v.workspace.folder}/archives"
    grouped = v.table("orders").select("o_orderkey", "o_custkey", F.floor(F.col("o_orderkey") / ARCHIVE_ORDERS).alias("no")).groupBy("no")
    # Spark's text writer puts files in any store; readers of ZIP files look for the directory from the end.
    (grouped.applyInArrow(_zip_orders, "value binary").select(F.col("value").cast("string"))
     .write.option("maxRecordsPerFile", 1).text(folder))
    return folder


@query("archive_member_names", "", f"""
SELECT CASE WHEN no % 7 <> 0 THEN 'Trips.txt|stop_times.txt' END AS gtfs_members, no % 7 = 0 AS failed, count(*) AS archives
FROM (SELECT DISTINCT o_orderkey // {ARCHIVE_ORDERS} AS no FROM orders) GROUP BY 1, 2""")
def _(v: Views):
    names = members.member_names(members.list_archives(v.spark, _order_archives(v)))
    return names.groupBy("gtfs_members", F.col("error").isNotNull().alias("failed")).agg(F.count("*").alias("archives"))


@query("archive_member_rows", "", f"""
SELECT 'trips' AS member, 't' || o_orderkey AS trip_id, 'r' || o_custkey AS detail FROM orders WHERE o_orderkey // {ARCHIVE_ORDERS} % 7 <> 0
UNION ALL SELECT 'stop_times', 't' || o_orderkey, CAST(28800 + 60 * i AS VARCHAR) FROM orders, (SELECT unnest([0, 1, 2]) AS i)
WHERE o_orderkey // {ARCHIVE_ORDERS} % 7 <> 0
UNION ALL SELECT 'error', NULL, NULL FROM (SELECT DISTINCT o_orderkey // {ARCHIVE_ORDERS} AS no FROM orders) WHERE no % 7 = 0""")
def _(v: Views):
    folder = _order_archives(v)
    files = members.list_archives(v.spark, folder).select(
        F.lit("o").alias("organization_id"), F.col("path").alias("feed_id"), F.lit("current").alias("version_selector"), "path")
    archives = members.Archives(files, v.workspace)
    tables_ = archives.tables()
    trips = tables_["trips"].select(F.lit("trips").alias("member"), "trip_id", F.col("route_id").alias("detail"))
    times = tables_["stop_times"].select(F.lit("stop_times"), "trip_id", F.col("arrival_sec").cast("string"))
    none = F.lit(None).cast("string")
    return trips.union(times).union(archives.errors().select(F.lit("error"), none, none))


# -- tables of text with an order, and tables without rows ---------------------


@query("src_manifest", "", """
SELECT 'org' || o_custkey AS organization_id, 'f' || o_orderkey AS feed_id, '' AS version_selector,
       'a, "b"' || chr(10) || o_orderpriority AS source_url, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_custkey END AS bytes,
       row_number() OVER (ORDER BY o_orderkey) - 1 AS row_ix FROM orders""")
def _(v: Views):
    key = F.col("o_orderkey")
    path = f"{v.workspace.folder}/manifest"
    v.table("orders").repartitionByRange("o_orderkey").sortWithinPartitions("o_orderkey").select(
        text("org", "o_custkey").alias("organization_id"), text("f", key).alias("feed_id"), F.lit("").alias("version_selector"),
        F.concat(F.lit('a, "b"\n'), "o_orderpriority").alias("source_url"),
        F.when(key % 3 == 0, "none").otherwise(F.col("o_custkey").cast("string")).alias("bytes"),
    ).write.option("escape", '"').csv(path, header=True)
    return lists.read_manifest(v.spark, path).select("organization_id", "feed_id", "version_selector", "source_url", "bytes", "row_ix")


@query("sink_empty_schema", "links_rows links", """
SELECT 'links_rows' AS name, count(*) AS rows, 'bigint' AS number, 'boolean' AS flag, sum(source_row)::BIGINT AS total FROM links_rows
UNION ALL SELECT 'links_operators', count(*), 'bigint', 'boolean', sum(source_rows)::BIGINT FROM links""")
def _(v: Views):
    parts = []
    for name, measured, schema, number, flag in (
        ("links_rows", v.links_rows, LINKS_ROWS, "source_row", "driver_valued"),
        ("links_operators", v.links.drop("row_ix"), LINKS_OPERATORS, "source_rows", "has_driver_count"),
    ):
        if [(f.name, f.dataType) for f in measured.schema] != [(f.name, f.dataType) for f in schema]:
            raise ValueError(f"{name}: empty and measured tables differ")
        both = tables.empty_table(v.spark, schema).unionByName(measured)
        parts.append(both.groupBy(F.lit(name).alias("name"), F.typeof(number).alias("number"), F.typeof(flag).alias("flag")).agg(
            F.count("*").alias("rows"), F.sum(number).alias("total")))
    return tables.union_tables(parts)
