"""Numbered lists read by byte ranges, against Spark's reader of whole files."""

import csv
import io
import random

from pyspark.sql import functions as F

from taktline.sources import lists
from taktline.sources.tables import read_csv

BOM = b"\xef\xbb\xbf"


def _write(folder, name, rng, n, first=0, end="\n", header=("feed_id", "source_url", "b.c", "bytes")):
    cells = ["x", 'a "b"', "c,d", "two\nlines", "", " ", "é", "a\r\nb", '"']
    out = io.StringIO()
    writer = csv.writer(out, lineterminator=end)
    writer.writerow(header)
    for i in range(n):
        writer.writerow([str(first + i), rng.choice(cells), rng.choice(cells), rng.choice(("1", "none", ""))][: rng.choice((2, 4, 4))] + rng.choice(([], [], ["too", "many"])))
        out.write(rng.choice(("", "", end)))
    (folder / name).write_bytes((BOM if first else b"") + out.getvalue().encode())


def test_numbers_and_cells_of_ranges(spark, tmp_path):
    rng = random.Random(11)
    _write(tmp_path, "a.csv", rng, 300)
    _write(tmp_path, "b.csv", rng, 200, 300)
    got = lists.read_numbered(spark, f"file:{tmp_path}", range_bytes=500)
    rows = sorted(got.collect(), key=lambda r: r.row_ix)
    assert got.columns == ["feed_id", "source_url", "b.c", "bytes", "row_ix"]
    assert [(r.row_ix, r.feed_id) for r in rows] == [(i, str(i)) for i in range(500)]
    whole = {tuple(r) for r in read_csv(spark, f"file:{tmp_path}").collect()}
    assert {tuple(r)[:-1] for r in rows} == whole
    assert not any(c is None for r in rows for c in r)


def test_a_large_file_is_read_by_many_tasks(spark, tmp_path):
    _write(tmp_path, "a.csv", random.Random(3), 400, end="\r\n")
    got = lists.read_numbered(spark, f"file:{tmp_path}/a.csv", range_bytes=400)
    assert got.rdd.getNumPartitions() > 1 or len(got.inputFiles()) > 1
    assert [r.feed_id for r in got.orderBy("row_ix").collect()] == [str(i) for i in range(400)]


def test_manifest_in_its_types(spark, tmp_path):
    (tmp_path / "m.csv").write_text('feed_id,organization_id,bytes\n"f\n1",o,12\n\nf2,,none\n')
    rows = lists.read_manifest(spark, f"file:{tmp_path}/m.csv").select("feed_id", "organization_id", "bytes", "row_ix").orderBy("row_ix").collect()
    assert [tuple(r) for r in rows] == [("f\n1", "o", 12, 0), ("f2", "", None, 1)]


def test_files_with_a_header_alone_and_compressed_ones(spark, tmp_path):
    (tmp_path / "e.csv").write_text("feed_id,bytes\n")
    assert lists.read_manifest(spark, f"file:{tmp_path}/e.csv").count() == 0
    spark.range(3).select(F.col("id").cast("string").alias("feed_id")).coalesce(1).write.csv(f"{tmp_path}/z", header=True, compression="gzip")
    assert sorted(r.feed_id for r in lists.read_manifest(spark, f"file:{tmp_path}/z").collect()) == ["0", "1", "2"]
