import io
import zipfile

import pytest
from pyspark.sql import functions as F

from taktline.plans.current import archive_timetable
from taktline.sources import archives as src, members
from taktline.workspace import Workspace

TABLES = {
    "Agency.TXT": "agency_id,agency_name,agency_url\n,伊予バス,https://iyo.example.jp/\n",
    "agency.txt": "agency_id\nsecond\n",
    "routes.txt": "route_id,agency_id,route_type\nr1,,3\n\nr2,\n",
    "trips.txt": 'service_id,trip_id,trip_id,extra\ns,old,"a ""b"",\n c",x,y\ns,t2\r\n',
    "stop_times.txt": "trip_id,stop_id,stop_sequence,arrival_time,departure_time\n" + "".join(f"t2,a{i},{i},8:00:00,8:00:00\n" for i in range(500)),
    "calendar_dates.txt": "",
    "feed_info.txt": "feed_start_date,feed_end_date\n20260928,20261004\n",
}


def packed(tables, damaged=False):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, body in tables.items():
            z.writestr(name, b"\xef\xbb\xbf" + body.encode())
    data = bytearray(out.getvalue())
    if damaged:
        at = data.rindex(b"calendar_dates.txt", 0, data.rindex(b"PK\x01\x02")) - 300
        data[at : at + 100] = bytes(100)
    return bytes(data)


@pytest.fixture()
def files(spark, tmp_path):
    contents = {"good 1%.zip": packed(TABLES), "good#2.zip": packed({"TRIPS.txt": "trip_id\nt\n"}), "half.zip": packed(TABLES, True),
                "none.zip": b"PK\x03\x04 no archive", "void.zip": b""}  # Spark lists no file without a byte
    for name, data in contents.items():
        (tmp_path / name).write_bytes(data)
    keys = [F.lit("o").alias("organization_id"), F.element_at(F.split("path", "/"), -1).alias("feed_id"), F.lit("current").alias("version_selector")]
    return members.list_archives(spark, f"file:{tmp_path}", "*.zip").select(*keys, "path", "length"), src.read_binary(
        spark, f"file:{tmp_path}", "*.zip").select(*keys, "path", "content")


def test_same_tables_as_whole_files(spark, files):
    listed, whole = files
    assert "content" not in listed.columns
    rows, errors = src.split_errors(src.unzip_members(whole))
    archives = members.Archives(listed, Workspace(spark))
    for member, typed in members.TYPED.items():
        assert sorted(map(str, typed(archives.rows(member)).collect())) == sorted(map(str, typed(rows).collect())), member
    failed = {r.feed_id for r in archives.errors().collect()}
    assert failed == {r.feed_id for r in errors.collect()} == {"half.zip", "none.zip"}
    trips = {(r.feed_id, r.trip_id) for r in archives.tables()["trips"].collect()}
    assert trips == {("good 1%.zip", 'a "b",\n c'), ("good 1%.zip", None), ("good#2.zip", "t")}


def test_members_are_units_of_work(spark, files, monkeypatch):
    monkeypatch.setattr(members, "TASK_BYTES", 1000)
    archives = members.Archives(files[0], Workspace(spark))
    assert archives._tasks("stop_times.txt") > 10 >= 8 >= archives._tasks("feed_info.txt")
    assert archives.rows("stop_times.txt").count() == 500


def test_no_files(spark, files):
    archives = members.Archives(files[0].where("false"), Workspace(spark))
    assert archives.errors().count() == 0 and all(t.count() == 0 for t in archives.tables().values())


def test_timetable(spark, files):
    timetable, errors = archive_timetable(files[0], files[0].where("feed_id = 'good#2.zip'").drop("length"), Workspace(spark))
    assert [r.trip_id for r in timetable.trips.collect()] == ["t"] and timetable.stop_times.count() == 0
    assert errors.count() == 0


def test_stores():
    assert members.openable("file:/a b/c.zip") and members.openable("/a/c.zip") and not members.openable("nostore://a/c.zip")
