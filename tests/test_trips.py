import random

import pytest
from pyspark.sql import functions as F

from taktline.operators import trips as tr

KEY = ("o", "f", "current")
SCHEMA = (
    "organization_id STRING, feed_id STRING, version_selector STRING, trip_id STRING, stop_id STRING, "
    "stop_sequence INT, arrival_sec BIGINT, departure_sec BIGINT, row_ix BIGINT"
)
STOPS = "organization_id STRING, feed_id STRING, version_selector STRING, stop_id STRING, stop_lat DOUBLE, stop_lon DOUBLE, row_ix BIGINT"


def stop_times(spark, rows):
    return spark.createDataFrame([(*KEY, *r) for r in rows], SCHEMA)


def test_span_uses_arrival_then_departure(spark):
    rows = [("t", "a", 1, None, 100, 1), ("t", "b", 2, 160, 170, 2), ("t", "c", 3, None, None, 3)]
    got = tr.trip_span(stop_times(spark, rows)).first()
    assert (got.first_sec, got.last_sec, got.seconds) == (100, 160, 60)


def test_missing_coordinate_is_not_bridged(spark):
    rows = [("t", s, i, None, None, i) for i, s in enumerate("abc")]
    stops = spark.createDataFrame([(*KEY, "a", 0.0, 0.0, 1), (*KEY, "b", None, None, 2), (*KEY, "c", 0.0, 1.0, 3)], STOPS)
    assert tr.trip_km(stop_times(spark, rows), stops).count() == 0
    known = stops.fillna(0.0)
    assert tr.trip_km(stop_times(spark, rows), known).first().km == pytest.approx(111.195, abs=1e-3)


@pytest.mark.parametrize("width,hot_rows,piece_rows", [(4096, 10**6, 65536), (4, 10**6, 8), (4, 5, 3), (1000, 2, 2)])
def test_pairs_do_not_depend_on_how_a_trip_is_cut(spark, width, hot_rows, piece_rows):
    random.seed(7)
    rows = [
        ("hot" if i % 3 else f"t{i % 7}", f"s{random.randrange(9)}", random.choice([0, 0, 1, 5, 9, 40, -3]),
         random.choice([None, i * 7]), None, i)
        for i in range(300)
    ]
    random.shuffle(rows)
    df = stop_times(spark, rows).repartition(5)
    args = dict(width=width, hot_rows=hot_rows, piece_rows=piece_rows)
    got = sorted((r.trip_id, r.from_stop, r.to_stop) for r in tr.stop_pairs(df, **args).collect())
    want, spans = [], {}
    for trip in {r[0] for r in rows}:
        ordered = sorted((r for r in rows if r[0] == trip), key=lambda r: (r[2], r[5]))
        want += [(trip, a[1], b[1]) for a, b in zip(ordered, ordered[1:])]
        times = [r[3] for r in ordered if r[3] is not None]
        spans[trip] = (times[0], times[-1])
    assert got == sorted(want)
    lookup = df.select(*tr.A, "trip_id").distinct().withColumns(
        {"agency_id": F.lit("a"), "service_id": F.lit("s"), "route_id": F.lit("r")}
    )
    got_spans, segments = tr.trip_facts(df, lookup, **args)
    assert {r.trip_id: (r.first_sec, r.last_sec) for r in got_spans.collect()} == spans
    assert segments.where("from_stop IS NOT NULL").agg(F.sum("n")).first()[0] == len(want)
    assert {r.to_stop for r in segments.collect()} == {r[1] for r in rows}
