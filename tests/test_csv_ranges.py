"""Ranges of CSV files against the csv module on whole files."""

import csv
import io
import random

import pytest
from pyspark.sql import functions as F

from taktline.sources import archives as src, csv_ranges as cr
from taktline.workspace import Workspace


def made(rng, n):
    return "".join(rng.choice(['"', '""', ",", "\n", "\r", "\r\n", "a", "é", "bc", "\n\n"]) for _ in range(n)).encode()


def whole(data):
    text = io.TextIOWrapper(io.BytesIO(data), encoding="utf-8-sig", errors="replace", newline="")
    return [r for r in csv.reader(text)]


def by_ranges(path, data, step):
    head = len(cr.BOM) if data.startswith(cr.BOM) else 0
    state, rows, n = cr.OUT, [], 0
    for start in range(0, len(data), step):
        stop = min(start + step, len(data))
        for header, number, row in cr._records(path, start, stop, state):
            n += row is not None
            rows.append((header, None if row is None else dict(row)))
        before = b"\n" if start == 0 else data[start - 1 : start]
        state = cr.states_after(before + data[max(start, head) : stop])[state]
    return rows


@pytest.mark.parametrize("block", (2, 1 << 20))
def test_same_rows_as_the_csv_module(tmp_path, monkeypatch, block):
    monkeypatch.setattr(cr, "BLOCK", block)
    rng, path = random.Random(block), tmp_path / "x.csv"
    for case in range(400):
        data = (cr.BOM if case % 3 == 0 else b"") + made(rng, rng.randrange(60)) + (b"\xff\n" if case % 5 == 0 else b"")
        if not data:
            continue
        path.write_bytes(data)
        first, *rest = whole(data) or [[]]
        want = [(first, None)] + [(first, dict(zip(first, r + [None] * (len(first) - len(r))))) for r in rest if r]
        for step in (4, 7, 16, 1000):
            assert by_ranges(str(path), data, step) == want, (data, step)


def test_states_of_ranges_compose():
    rng = random.Random(5)
    for _ in range(300):
        data = b"\n" + made(rng, 40)
        at = rng.randrange(1, len(data))
        left, right = cr.states_after(data[:at]), cr.states_after(data[at - 1 :])
        assert cr.states_after(data)[cr.OUT] == right[left[cr.OUT]]


@pytest.fixture()
def folder(tmp_path):
    cells = ["x", 'a "b"', "c,d", "two\nlines", "\r\n", "é"]
    rng, out = random.Random(1), io.StringIO()
    writer = csv.writer(out)
    writer.writerow(["事業者名", "年度", "年度"])
    writer.writerows([[rng.choice(cells), str(i), rng.choice(cells)][: rng.choice((1, 3, 3))] for i in range(500)])
    (tmp_path / "big.csv").write_bytes(cr.BOM + out.getvalue().encode())
    (tmp_path / "transport.csv").write_bytes(b"h1,h2\n")
    (tmp_path / "bad.csv").write_bytes(b"h\n" + b"y" * 200_000 + b"\n")  # a field beyond the limit of the csv module
    (tmp_path / "book.xlsx").write_bytes(b"PK")
    (tmp_path / "none.zip").write_bytes(b"PK\x03\x04 no archive")
    (tmp_path / "fetch_status.csv").write_text("status\n403\n")
    return tmp_path


def test_folder_of_statistics(spark, folder):
    found = cr.Statistics(spark, f"file:{folder}", Workspace(spark), range_bytes=700)
    assert found.csv.tasks > 20
    text = lambda df: sorted(map(str, df.select("path", "source_file", "dataset", "source_row", "columns", F.to_json("row")).collect()))
    assert text(found.records()) == text(src.links_records(src.links_files(spark, f"file:{folder}")))
    name = F.element_at(F.split("path", "/"), -1).alias("name")
    status = {r.name: (r.status, r.rows) for r in found.status().select(name, "status", "rows").collect()}
    assert status == {"big.csv": ("read", 500), "transport.csv": ("read", 0), "bad.csv": ("unreadable", None),
                      "book.xlsx": ("spreadsheet_not_decoded", None), "none.zip": ("unreadable", None)}
    assert status == {r.name: (r.status, r.rows) for r in src.links_status(src.links_files(spark, f"file:{folder}")).select(name, "status", "rows").collect()}


def test_spreadsheets_alone_are_unknown_not_zero(spark, tmp_path):
    (tmp_path / "book.xlsx").write_bytes(b"PK")
    found = cr.Statistics(spark, f"file:{tmp_path}", Workspace(spark))
    assert found.records_or_none() is None and found.records().count() == 0
    assert [r.status for r in found.status().collect()] == ["spreadsheet_not_decoded"]


def test_rows_of_a_file_stay_where_they_are(spark, tmp_path):
    from taktline.checks.source_queries import _in_files, _numbered_on

    orders = spark.range(95).selectExpr("94 - id AS o_orderkey").coalesce(1)
    _in_files(orders, 20).selectExpr("o_orderkey AS n").write.csv(f"{tmp_path}/x", header=True)
    found = cr.Statistics(spark, f"{tmp_path}/x", Workspace(spark), range_bytes=16)
    rows = found.records().where("row IS NOT NULL")
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "ShuffledHashJoin" not in plan
    assert found.files.count() == 5
    assert {r.source_row: int(r.row["n"]) for r in _numbered_on(rows, found.status()).collect()} == {i + 1: i for i in range(95)}
