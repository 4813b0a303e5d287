"""Records in lists: what the fast ways give is what zipfile and csv give."""

import io
import zipfile

import pytest

from taktline.schemas import MEMBER
from taktline.sources import archives as src

WANTED = frozenset(src.TABLES)
LINES = "trip_id,stop_sequence\n" + "".join(f"t{i},{i}\n" for i in range(50))


def packed(members, method=zipfile.ZIP_DEFLATED, comment=b"", extra=b""):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", method) as archive:
        for name, body in members:
            info = zipfile.ZipInfo(name)
            info.compress_type, info.extra = method, extra
            archive.writestr(info, body)
        archive.comment = comment
    return out.getvalue()


def damaged(data, member):
    data = bytearray(data)
    at = data.index(member) + 60
    data[at : at + 40] = bytes(40)
    return bytes(data)


MANY = [("Routes.TXT", "route_id,route_type\nr,3\n"), ("routes.txt", "x\n9\n"), ("stop_times.txt", LINES), ("notes.csv", "x\n1\n")]
CASES = {
    "plain": packed(MANY), "stored": packed(MANY, zipfile.ZIP_STORED), "comment": packed(MANY, comment=b"by hand"),
    "extra": packed(MANY, extra=b"\x99\x99\x02\x00ab"), "none": b"PK no archive", "empty": b"", "no members": packed([]), "cut": packed(MANY)[:300],
    "unknown method": packed(MANY, zipfile.ZIP_LZMA), "damaged": damaged(packed(MANY), b"stop_times.txt"),
    "same name twice": packed([("trips.txt", "trip_id\na\n"), ("trips.txt", "trip_id\nb\n")]),
    "text": packed([
        ("trips.txt", "﻿trip_id,note\r\n1,\r\n,é\r\n"), ("stops.txt", 'a,b\n"q\n,""",\n'), ("agency.txt", "a,b,a\n1,2,3\n"),
        ("calendar.txt", "a,b\n1\n\n1,2,3\n")]),
    "lines": packed([("trips.txt", "a,b\n"), ("stops.txt", ""), ("agency.txt", "\nx\n"), ("routes.txt", "a\rb\r\nc"), ("calendar.txt", "a\n1\n\n"), ("feed_info.txt", "a,b\n1\n1,2\n")]),
    "bytes": packed([("trips.txt", b"a,b\n\xff\xfe,\xe3\x81\n\x00,2\n"), ("stop_times.txt", "a\n" + "x" * src.SMALL_BYTES)]),
    "long cell": packed([("trips.txt", "a\n1\n" + "x" * (2 * src.SMALL_BYTES) + "\n2\n")]),
}


def given(batches):
    """Rows of batches as the columns of MEMBER, without the outcome, and the outcomes by path."""
    rows, whole = [], {}
    for r in (r for b in batches for r in b.to_pylist()):
        whole.setdefault(r["path"], set()).add(r["whole"])
        for i, cells in enumerate(r["cells"] if r["cells"] is not None else [None]):
            number = None if r["first_ix"] is None else r["first_ix"] + i
            rows.append((r["path"], r["member"], r["header"], number, dict(zip(r["names"], cells)) if cells is not None else None, r["error"]))
    return sorted(rows, key=str), whole


def wanted_rows(path, content, members):
    rows = []
    try:
        for p, member, header, number, names, cells, error in src._records(path, content, members):
            rows.append((p, member, header, number, dict(zip(names, cells)) if cells is not None else None, error))
    except Exception as error:
        rows.append((path, None, None, None, None, repr(error)))
    return rows


@pytest.mark.parametrize("members", [WANTED, None])
@pytest.mark.parametrize("held", [1 << 15, 7])
def test_cells_are_those_of_zipfile_and_csv(monkeypatch, members, held):
    monkeypatch.setattr(src, "HELD_RECORDS", held)
    files = [((f"{name}.zip",), data) for name, data in CASES.items()]
    files += [(("a/b.CSV",), LINES.encode()), (("q.csv",), b'a\n"1\n'), ((None,), b"x"), (("null.zip",), None)]
    rows, whole = given(src._cell_batches(iter(files), members, 0))
    want = [r for (path,), content in files for r in wanted_rows(path, content, members)]
    assert rows == sorted(want, key=str)
    failed = {r[0] for r in want if r[5] is not None}
    assert {p for p, w in whole.items() if w == {False}} == failed
    assert all(w == {True} for p, w in whole.items() if p not in failed)


def test_sound_members_need_no_zipfile():
    assert src._small_members(CASES["plain"], WANTED) == [("routes.txt", MANY[0][1].encode()), ("stop_times.txt", LINES.encode())]
    assert src._small_members(CASES["plain"], None) == [("notes.csv", b"x\n1\n")]
    for name in ("comment", "extra", "none", "cut", "damaged", "same name twice", "long cell"):
        assert src._small_members(CASES[name], WANTED) is None, name


def test_small_members_of_many_archives_are_one_batch():
    files = [(("o", f"{i}.zip"), CASES["plain"]) for i in range(100)]
    batches = list(src._cell_batches(iter(files), WANTED, 1))
    assert [b.num_rows for b in batches] == [200] and batches[0].column(0).to_pylist() == ["o"] * 200


def test_rows_of_whole_archives_without_a_join_of_all_rows(spark):
    files = spark.createDataFrame(
        [("good.zip", CASES["plain"]), ("bad.zip", CASES["damaged"]), ("good.zip", CASES["plain"]),
         ("both.zip", CASES["plain"]), ("both.zip", CASES["cut"])], "path string, content binary")
    members = src.unzip_members(files)
    assert [(f.name, f.dataType) for f in members.schema] == [(f.name, f.dataType) for f in MEMBER]
    rows, errors = src.split_errors(members)
    assert sorted(r.path for r in errors.collect()) == ["bad.zip", "both.zip"]
    # As before: a path of which one file fails has no rows; a file that is listed twice has them twice.
    assert {(r.path, r["count"]) for r in rows.groupBy("path").count().collect()} == {("good.zip", 2 * (2 + 51))}
    plan = rows._jdf.queryExecution().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    old, _ = src.split_errors(members.drop("whole"))
    assert sorted(map(str, old.collect())) == sorted(map(str, rows.drop("whole").collect()))
    # Errors are chosen before lists become rows.
    steps = errors._jdf.queryExecution().optimizedPlan().toString()
    assert steps.index("Generate") < steps.index("Filter") < steps.index("MapInArrow")


def test_members_are_written_side_by_side(spark, tmp_path):
    files = spark.createDataFrame([(f"{i}.zip", CASES["plain" if i % 3 else "damaged"]) for i in range(9)], "path string, content binary")
    before = spark.conf.get(src.WRITERS)
    src.write_members(src.unzip_members(files), f"{tmp_path}/members")
    assert spark.conf.get(src.WRITERS) == before
    saved = spark.read.parquet(f"{tmp_path}/members")
    assert {(r.member, r["count"]) for r in src.split_errors(saved)[0].groupBy("member").count().collect()} == {("routes.txt", 12), ("stop_times.txt", 306)}
    assert src.split_errors(saved)[1].count() == 3
