import datetime as dt
import hashlib
import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from taktline.operators import links
from taktline.plans import outputs
from taktline.plans.audit import audit_run
from taktline.plans.catalog import fetch_plan, record_fetch
from taktline.plans.current import current_service
from taktline.plans.history import history_run
from taktline.sources import archives as src, lists, members as members_of, registry as reg, tables
from taktline.workspace import Workspace

FEED = {
    "agency.txt": "agency_id,agency_name,agency_url\n,伊予バス,https://iyo.example.jp/\n",
    "routes.txt": "route_id,agency_id,route_type\nr1,,3\nr2,,2\n",
    "trips.txt": "trip_id,route_id,service_id\nt1,r1,s\nt2,r1,s\nt3,r2,s\n",
    "stops.txt": "stop_id,stop_lat,stop_lon\na,0,0\nb,0,1\n",
    "stop_times.txt": "trip_id,stop_id,stop_sequence,arrival_time,departure_time\n"
                      "t1,a,1,,8:00:00\nt1,b,2,9:00:00,9:00:00\nt2,a,1,8:30:00,8:30:00\nt2,b,2,9:30:00,\n",
    "calendar.txt": "service_id,monday,tuesday,wednesday,thursday,friday,saturday,sunday,start_date,end_date\n"
                    "s,1,1,1,1,1,0,0,20260928,20261004\n",
    "feed_info.txt": "feed_start_date,feed_end_date\n20260928,20261004\n",
}


def archive(feed, bom=b"\xef\xbb\xbf", rename=str.upper):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in feed.items():
            z.writestr(rename(name), bom + text.encode("utf-8"))
    return out.getvalue()


@pytest.fixture()
def folder(tmp_path):
    old = {**FEED, "trips.txt": FEED["trips.txt"].replace("t2,r1,s\n", "")}
    old["calendar.txt"] = FEED["calendar.txt"].replace("2026", "2025")
    old["feed_info.txt"] = FEED["feed_info.txt"].replace("2026", "2025")
    (tmp_path / "gtfs").mkdir()
    (tmp_path / "gtfs" / "o__f__current.zip").write_bytes(archive(FEED))
    (tmp_path / "gtfs" / "o__f__prev_1.zip").write_bytes(archive(old, rename=str))
    (tmp_path / "gtfs" / "broken.zip").write_bytes(b"PK\x03\x04 not really")
    return tmp_path


def manifest(spark, folder):
    rows = []
    for i, (selector, stamp) in enumerate((("current", "20260928"), ("prev_1", "20250928"))):
        path = f"file:{folder}/gtfs/o__f__{selector}.zip"
        rows.append(("o", "f", selector, "200", path, f"h{i}", f'x; filename="f_{stamp}_{stamp}120000.zip"', "", i))
    rows.append(("o", "f", "prev_2", "404", "", "", "", "", 2))
    return spark.createDataFrame(
        rows, "organization_id STRING, feed_id STRING, version_selector STRING, status STRING, path STRING, "
              "sha256 STRING, content_disposition STRING, source_url STRING, row_ix BIGINT")


def registry(spark, folder):
    feed = {"organization_id": "o", "organization_name": "Town", "feed_id": "f", "feed_name": "Feed", "feed_pref_id": 38,
            "latest_feed_start_date": "2026-09-28", "latest_feed_end_date": "2026-10-04",
            "feed_is_discontinued": False, "organization_email": "x@y.jp"}
    (folder / "registry").mkdir(exist_ok=True)
    (folder / "registry" / "feeds.json").write_text(json.dumps({"code": 200, "body": [feed]}, indent=2), encoding="utf-8")
    return reg.read_registry(spark, f"file:{folder}/registry")


def test_registry(spark, folder):
    feeds = registry(spark, folder)
    assert feeds.first().latest_feed_end_date == dt.date(2026, 10, 4)
    assert "organization_email" not in reg.registry_redact(feeds).columns
    bad = spark.createDataFrame([(json.dumps({"code": 500, "body": []}),)], "value STRING")
    with pytest.raises(Exception, match="unexpected registry response"):
        reg.parse_registry(bad).collect()


def test_fetch_books(spark, folder):
    feeds, log = registry(spark, folder), manifest(spark, folder)
    plan = fetch_plan(feeds, log, dt.date(2026, 9, 29), depth=5, mode="both")
    assert plan["worklist"].count() == 0 and plan["gtfs_excluded_registry_feeds"].count() == 0
    fresh = log.where("version_selector = 'prev_1'")
    deeper = fetch_plan(feeds, fresh, dt.date(2026, 9, 29), depth=3, mode="both")
    assert sorted(r.version_selector for r in deeper["worklist"].collect()) == ["current", "prev_2", "prev_3"]
    late = fetch_plan(feeds, log, dt.date(2027, 1, 1))
    assert late["gtfs_excluded_registry_feeds"].first().reason == "outside_anchor_date"
    coverage = spark.createDataFrame([("o", "f", 2)], "organization_id STRING, feed_id STRING, requested_history_depth INT")
    books = record_fetch(log, fresh.withColumn("sha256", F.lit("new")), coverage, deeper["requested_feeds"],
                         late["gtfs_excluded_registry_feeds"], 3)
    assert books["manifest"].count() == 3 and books["manifest"].where("sha256 = 'new'").count() == 1
    assert books["gtfs_history_fetch_coverage"].first().requested_history_depth == 3


def test_members(spark, folder):
    files = src.read_binary(spark, f"file:{folder}/gtfs", "*.zip")
    members = src.unzip_members(files)
    assert [r.path.rsplit("/", 1)[-1] for r in src.archive_errors(members).collect()] == ["broken.zip"]
    keyed = src.with_archive_keys(members, manifest(spark, folder))
    assert {(r.version_selector, r.agency_name) for r in src.agency_table(keyed).collect()} == {
        ("current", "伊予バス"), ("prev_1", "伊予バス")}
    times = src.stop_times_table(keyed).where("version_selector = 'current'").orderBy("row_ix").collect()
    assert [(t.arrival_sec, t.departure_sec) for t in times] == [(None, 28800), (32400, 32400), (30600, 30600), (34200, None)]
    digests = {r.path.rsplit("/", 1)[-1]: (r.sha256, r.bytes) for r in src.archive_digest(files).collect()}
    data = (folder / "gtfs" / "broken.zip").read_bytes()
    assert digests["broken.zip"] == (hashlib.sha256(data).hexdigest(), len(data))
    target = f"file:{folder}/members"
    src.write_members(keyed, target)
    assert src.trips_table(spark.read.parquet(target)).count() == 5


def test_batches_keep_all_rows(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(src, "BATCH_ROWS", 3)
    body = "x\n" + "".join(f"{i}\n" for i in range(20))
    records = list(src._records("a.csv", body.encode(), None))
    batches = list(src._batches(iter(records)))
    assert [b.num_rows for b in batches] == [3] * 7 and len(records) == 21


def test_three_runs_from_end_to_end(spark, folder):
    members = src.with_archive_keys(
        src.unzip_members(src.read_binary(spark, f"file:{folder}/gtfs", "*.zip")), manifest(spark, folder))
    feeds, log = registry(spark, folder), manifest(spark, folder)
    now = current_service(feeds, log, members, dt.date(2026, 9, 29), Workspace(spark))
    metrics = now["gtfs_agency_metrics"].first()
    assert metrics.agency_id == "__single__" and metrics.prefecture == "愛媛県"
    assert (metrics.route_count, metrics.trip_count, metrics.stop_count) == (1, 2, 2)
    # Monday to Friday of one week, two trips of one hour each.
    assert (metrics.weekday_trips_per_day_avg, metrics.weekend_trips_per_day_avg) == (2.0, 0.0)
    assert metrics.weekday_trip_hours_per_day_approx == 2.0
    assert metrics.weekday_km_per_day_straight_line_approx == pytest.approx(222.39, abs=0.001)
    assert (metrics.first_departure, metrics.last_arrival) == ("08:00", "09:30")
    assert metrics.mean_route_headway_min_approx == 30.0 and metrics.operating_days_in_window == 5
    meta = now["run_metadata"].first()
    assert (meta.selected_anchor_feed_archives, meta.excluded_feeds, dict(meta.selected_archive_versions)) == (1, 0, {"current": 1})
    coverage = spark.createDataFrame([("o", "f", 12)], "organization_id STRING, feed_id STRING, requested_history_depth INT")
    past = history_run(feeds, log, coverage, members, now["gtfs_agency_metrics"], Workspace(spark), operators=now["gtfs_operator_metrics"])
    assert past["gtfs_history_summary"].first().agency_name == past["gtfs_supply_yoy"].first().agency_name == "伊予バス"
    feed = now["gtfs_feed_metrics"].first()
    assert (feed.feed_name, feed.publisher_name, feed.prefecture) == ("Feed", "Town", "愛媛県") and feed.source_zip.endswith("current.zip")
    assert {r.version_selector: r.classification for r in past["gtfs_history_versions"].collect()} == {
        "current": "latest_distinct_generation", "prev_1": "timetable_content_changed"}
    summary = past["gtfs_history_summary"].first()
    assert summary.years_1plus_all_feeds is True and summary.years_2plus_all_feeds is False
    assert summary.history_status == "measured_same_agency_across_all_feeds"
    yoy = past["gtfs_supply_yoy"].first()
    assert (yoy.weekday_trips_per_day_previous, yoy.weekday_trips_per_day_current) == (1.0, 2.0)
    assert yoy.weekday_trips_yoy_pct == 100.0
    body = ("事業者名,事業者番号,対象年度,事業区分,住所,輸送人員,車両数,営業収入,運転者数\n"
            "株式会社伊予バス,1,2024年度,乗合,松山,10,2,3,\n株式会社伊予バス,1,2024年度,乗合,松山,10,2,3,4\n別会社,2,2024,乗合,松山,-,2,3,4\n")
    (folder / "links").mkdir()
    (folder / "links" / "yusoujisseki.csv").write_text(body, encoding="utf-8-sig")
    (folder / "links" / "both.zip").write_bytes(archive({"busreport.csv": body}, rename=str))
    (folder / "links" / "fetch_status.csv").write_text("status\n403\n")
    (folder / "links" / "notes.txt").write_text("x")
    files = src.links_files(spark, f"file:{folder}/links")
    assert sorted(r.name for r in files.collect()) == ["both.zip", "yusoujisseki.csv"]
    audit = audit_run(
        spark, now["gtfs_operator_metrics"], past["gtfs_history_summary"], past["gtfs_supply_yoy"],
        src.links_records(files), feeds, None, Workspace(spark))
    assert [r.operator_count for r in audit["funnel_summary"].collect()] == [1, 1, 1, 1, 1, 0, 0]
    assert audit["matched_operators"].first().match_class == "B"
    assert audit["region_detail"].count() == 1 and "weekday_km_sum_approx" in audit["region_detail"].columns
    assert {"full_complete_supply_stress_test"} <= set(audit["prefecture_summary"].columns)
    full = {(r.source_file, r.field): r for r in audit["field_completeness"].collect()}
    row = full["yusoujisseki.csv", "passenger_count"]
    assert (row.rows_total, row.rows_nonblank, row.unique_operator_ids_nonblank) == (3, 2, 1)
    assert {r.limitations[:14] for r in audit["indicator_feasibility"].collect()} == {"Measured from ", "Computed count"}
    none = audit_run(
        spark, now["gtfs_operator_metrics"], past["gtfs_history_summary"], None, None, feeds, current=now, anchor=dt.date(2026, 9, 29))
    notes = {r.gap_or_grain: (r["count"], r.note) for r in none["data_gap_summary"].collect()}
    assert notes["gtfs_archive_valid_on_anchor"] == (1, "Selected archives have an internal feed_info validity window containing 2026-09-29.")
    assert notes["gtfs_entities_with_multiple_feeds"][1].startswith("Maximum component feeds per entity=1;") and len(notes) == 17
    assert all(r.note for r in none["grain_summary"].collect())
    assert {r.limitations[:4] for r in none["indicator_feasibility"].collect()} == {"GTFS", "0 co"}
    listed = members_of.member_names(members_of.list_archives(spark, f"file:{folder}/gtfs", "*.zip"))
    named = history_run(feeds, log, coverage, members, now["gtfs_agency_metrics"], Workspace(spark),
                        names=src.keyed_files(listed, log))["gtfs_history_versions"].collect()
    for r in named:
        assert r.gtfs_members == "|".join(zipfile.ZipFile(folder / "gtfs" / f"o__f__{r.version_selector}.zip").namelist())
    outputs.write_current(spark, now, dt.date(2026, 9, 29), f"file:{folder}/out")
    assert spark.read.json(f"file:{folder}/out/run_metadata").first().asDict(True) == {
        **meta.asDict(True), "selected_archive_versions": {"current": 1}}
    assert spark.read.parquet(f"file:{folder}/out/gtfs_agency_metrics").count() == 1
    assert {r.rows_total for r in none["field_completeness"].collect()} == {None}
    assert [r.operator_count for r in none["funnel_summary"].collect()] == [1] + [None] * 6


def test_rows_have_to_be_complete_by_themselves(spark):
    rows = spark.createDataFrame(
        [("L", "2024", "p", "transport_performance", "1", "", "3", "4"),
         ("L", "2024", "p", "transport_performance", "", "2", "", "4"),
         ("L", "2024", "p", "business_overview", "", "", "", "")],
        "links_operator_id STRING, year STRING, permit_type STRING, dataset STRING, passenger_count STRING, "
        "vehicle_count STRING, revenue STRING, driver_count STRING")
    row = links.common_year_permit(links.transport_complete(rows)).first()
    assert (row.transport_complete, row.driver_complete) == (False, False)


def test_header_rules(spark):
    columns = ["事業者番号", "事業者名", "延実在車両数", "車両数", "都道府県名"]
    df = spark.createDataFrame([(columns,)], "c ARRAY<STRING>")
    got = df.select(*[c.alias(k) for k, c in links.map_fields(F.col("c")).items()]).first()
    assert got.operator_name == ["事業者番号", "事業者名"] and got.vehicle_count == ["車両数"]
    assert got.extended_actual_vehicle_count == ["延実在車両数"]
    assert df.select(links.pick_column(F.col("c"))["prefecture_address"]).first()[0] == "都道府県名"


def test_lists_and_tables(spark, tmp_path):
    (tmp_path / "ids.txt").write_text("o,f\n o , f \nnone\no,a,b\n")
    pairs = lists.read_feed_pairs(spark, f"file:{tmp_path}/ids.txt")
    assert sorted(map(tuple, pairs.collect())) == [("o", "a,b"), ("o", "f")]
    assert lists.approved_aliases(None, spark).count() == 0
    (tmp_path / "log.csv").write_text('status,url\n403,"a,b"\n', encoding="utf-8-sig")
    (tmp_path / "log.json").write_text(json.dumps([{"status": 403, "reason": "x"}, {"status": 200}], indent=1))
    log = tables.fetch_status_log(spark, f"file:{tmp_path}/log.csv", f"file:{tmp_path}/log.json")
    assert {r.status: r.attempts for r in tables.status_counts(log).collect()} == {"403": 2, "200": 1}
    assert log.columns[0] == "status"


def test_damaged_archive_is_an_error_and_in_no_metric(spark, folder):
    """An archive that fails half way is selected, reported and not counted."""
    data = bytearray(archive({**FEED, "trips.txt": FEED["trips.txt"] + "".join(f"x{i},r1,s\n" for i in range(9))}))
    at = data.index(b"STOP_TIMES.TXT") + 40
    data[at : at + 30] = bytes(30)
    (folder / "gtfs" / "o__f__current.zip").write_bytes(data)
    listed = manifest(spark, folder).withColumn("path", F.regexp_replace("path", "^file:.*/gtfs/", "gtfs/"))
    files = src.read_binary(spark, f"file:{folder}/gtfs", "*.zip")
    assert [r.path.rsplit("/", 1)[-1] for r in src.unlisted_files(files, listed).collect()] == ["broken.zip"]
    target = f"file:{folder}/members"
    src.write_members(src.unzip_members(src.keyed_files(files, listed)), target)
    members = spark.read.parquet(target)
    rows, errors = src.split_errors(members)
    assert [r.version_selector for r in errors.collect()] == ["current"]
    assert {r.version_selector for r in rows.select("version_selector").distinct().collect()} == {"prev_1"}
    feeds = registry(spark, folder)
    now = current_service(feeds, listed, members, dt.date(2026, 9, 29), Workspace(spark))
    assert now["gtfs_agency_metrics"].count() == 0 and now["gtfs_analysis_errors"].count() == 1
    meta = now["run_metadata"].first()
    assert (meta.errors, meta.selected_anchor_feed_archives, meta.excluded_feeds) == (1, 1, 1)
    coverage = spark.createDataFrame([("o", "f", 12)], "organization_id STRING, feed_id STRING, requested_history_depth INT")
    past = history_run(feeds, listed, coverage, members, now["gtfs_agency_metrics"], Workspace(spark))
    versions = {r.version_selector: r for r in past["gtfs_history_versions"].collect()}
    assert versions["current"].classification == "analysis_error" and versions["current"].error
    assert versions["prev_1"].classification == "latest_distinct_generation" and versions["prev_1"].error is None


def test_listing_with_schemes_meets_relative_paths(spark):
    from taktline.operators.catalog import successful_archives

    manifest = spark.createDataFrame(
        [("a", "data/o/a.zip", "200"), ("b", "data\\o\\b.zip", "200"), ("c", "data/o/c.zip", "200"), ("d", "/abs/data/d.zip", "200"), ("e", "data/o/e.zip", "404"), ("f", "", "200")],
        "feed_id string, path string, status string")
    listing = spark.createDataFrame([(p,) for p in ("file:/srv/data/o/a.zip", "file:///srv/data/o/b.zip", "file:/srv/data/xo/c.zip", "/abs/data/d.zip", "file:/srv/data/o/e.zip", "file:/srv/data/o/a.zip", "")], "path string")
    got = successful_archives(manifest, listing)
    assert got.columns == manifest.columns and sorted(r.feed_id for r in got.collect()) == ["a", "b", "d"]


def test_archives_made_of_one_row_group_are_opened_by_many_tasks(spark, tmp_path):
    from taktline.checks.links_views import LinksViews
    from taktline.checks.source_queries import _feeds

    spark.range(300).withColumnRenamed("id", "o_orderkey").coalesce(1).write.parquet(f"{tmp_path}/orders.parquet")
    opened = src.unzip_members(_feeds(LinksViews(spark, str(tmp_path)))).select(F.spark_partition_id().alias("p"))
    assert opened.distinct().count() >= spark.sparkContext.defaultParallelism


def test_unzipped_rows_are_those_of_dict_reader(spark):
    import csv

    texts = ["a,b,a\n1,2,3\n\n4\n5,6,7,8\n", "a,b\n", "", "\nx\n", 'a,b\n"q\n,""",\n']
    out = io.BytesIO()
    names = sorted(src.TABLES)[: len(texts)]
    with zipfile.ZipFile(out, "w") as archive:
        for name, text in zip(names, texts):
            archive.writestr(name, text)
    files = spark.createDataFrame([("x.zip", out.getvalue())], "path string, content binary")
    got = {(r.member, r.row_ix): (r.header, r.row) for r in src.unzip_members(files).collect()}
    want = {}
    for name, text in zip(names, texts):
        reader = csv.DictReader(io.StringIO(text, newline=""))
        header = list(reader.fieldnames or [])
        want[name, 0] = (header, None)
        for i, row in enumerate(reader, 1):
            want[name, i] = (header, {k: v for k, v in row.items() if k is not None})
    assert got == want
