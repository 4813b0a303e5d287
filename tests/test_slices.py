"""Stop times that get their coordinates in several steps, and what these leave on the disks."""

import os

from pyspark.sql import functions as F

from taktline.operators import trips as tr
from taktline.workspace import CLEANUP, CODEC, Lazy, Workspace

KEYS = "organization_id string, feed_id string, version_selector string"


def timetable(spark):
    rows = [("o", f"f{f}", v, f"t{t}", f"s{(t * 7 + i) % 11}", i, 60 * i, None, i)
            for f in range(6) for v in ("current", "prev_1") for t in range(3) for i in range(4 + t)]
    times = spark.createDataFrame(rows, f"{KEYS}, trip_id string, stop_id string, stop_sequence int, arrival_sec int, departure_sec int, row_ix long")
    stops = times.select(*tr.A, "stop_id").distinct().withColumn("n", F.substring("stop_id", 2, 9).cast("int")).select(
        *tr.A, "stop_id", F.when(F.col("n") != 5, F.lit(33.0) + F.col("n") / 100).alias("stop_lat"), F.lit(132.0).alias("stop_lon"), F.col("n").cast("long").alias("row_ix"))
    lookup = times.select(*tr.TRIP).distinct().select("*", F.lit("a").alias("agency_id"), F.lit("s").alias("service_id"), F.lit("r").alias("route_id"))
    return times, stops, lookup


def visits(spark, workspace, width):
    times, stops, lookup = timetable(spark)
    _, segments = tr.trip_facts(times, lookup, width, workspace=workspace, stops=stops)
    found = segments.groupBy(*tr.A, "agency_id", "service_id", "to_stop").agg(F.sum("n").alias("n"), F.round(F.sum("km"), 9).alias("km"))
    return sorted(map(str, found.collect()))


def test_slices_give_what_one_step_gives(spark, monkeypatch):
    want = visits(spark, Lazy(), 2)
    monkeypatch.setattr(tr, "SLICE_ROWS", 20)
    workspace = Workspace(spark)
    assert visits(spark, workspace, 2) == want
    # 180 stop times: nine steps, each of them a table of its own.
    assert sum("-visits_" in name for name in os.listdir(workspace.folder.removeprefix("file:"))) == 9
    assert visits(spark, Lazy(), 2) == want


def test_no_stop_times(spark):
    times, stops, lookup = timetable(spark)
    _, segments = tr.trip_facts(times.where("false"), lookup, workspace=Workspace(spark), stops=stops)
    assert segments.count() == 0


def test_compact_steps_leave_no_shuffle_files(spark):
    workspace = Workspace(spark)
    before = [spark.conf.get(c) for c in (CLEANUP, CODEC)]
    with workspace.compact():
        assert [spark.conf.get(c) for c in (CLEANUP, CODEC)] == ["true", "zstd"]
        one, two = workspace.together(*(lambda n=n: workspace.keep(spark.range(100).groupBy((F.col("id") % n).alias("k")).count(), f"t{n}") for n in (3, 5)))
    assert [spark.conf.get(c) for c in (CLEANUP, CODEC)] == before
    assert (one.count(), two.count()) == (3, 5)
    assert all(".zstd." in f for f in map(os.path.basename, one.inputFiles()))
