import datetime as dt
import random

from pyspark.sql import functions as F

from taktline.operators import digest, history
from taktline.operators.ordering import running_number

V = ("organization_id STRING, feed_id STRING, version_selector STRING, timetable_signature STRING, "
     "validity_signature STRING, sha256 STRING, upload_utc TIMESTAMP, effective_start DATE, row_ix BIGINT")


def versions(spark, rows):
    out = [("o", "f", "current" if i == 0 else f"prev_{i}", *r[:3], None, r[3], i) for i, r in enumerate(rows)]
    return spark.createDataFrame(out, V)


def test_classes(spark):
    rows = [("A", "v", "h", None), ("B", "v", "h", None), ("A", "w", "h", None), ("A", "v", "g", None),
            ("A", "v", "h", None), (None, None, "h", None)]
    got = history.version_classify(versions(spark, rows)).orderBy("row_ix").collect()
    assert [r.classification for r in got] == [
        "latest_distinct_generation", "timetable_content_changed", "validity_window_only",
        "same_timetable_reupload_or_metadata_only", "byte_identical_duplicate", "analysis_error",
    ]
    assert [r.distinct_generation_number for r in got] == [1, 2, None, None, None, None]


def test_span(spark):
    rows = [("A", "v", "h", dt.date(2026, 1, 1)), ("B", "v", "h", dt.date(2024, 1, 1))]
    got = history.feed_history(history.version_classify(versions(spark, rows))).first()
    assert (got.history_span_days, got.history_2plus_year, got.history_3plus_year) == (731, True, False)
    unknown = history.feed_history(history.version_classify(versions(spark, [("A", "v", "h", None)]))).first()
    assert unknown.history_span_days is None and unknown.date_evidence_status == "effective_schedule_date_unavailable"


def test_running_number_over_a_hot_key(spark):
    random.seed(3)
    rows = [("hot" if i % 3 else f"k{i % 5}", v) for i, v in enumerate(random.sample(range(5000), 400))]
    df = spark.createDataFrame(rows, "k STRING, v INT")
    got = running_number(df, ["k"], [F.col("v")], F.expr("v div 37"), "n").collect()
    for key in {k for k, _ in rows}:
        mine = sorted((r.v, r.n) for r in got if r.k == key)
        assert [n for _, n in mine] == list(range(1, len(mine) + 1))


def flags(spark, ended, spans=(800, 400)):
    pairs = spark.createDataFrame([("op", "o", "f1"), ("op", "o", "f2")], "operator_id STRING, organization_id STRING, feed_id STRING")
    metrics, reps = [], []
    for feed, span in zip(("f1", "f2"), spans):
        for sig, sel, day in (("A", "current", 0), ("B", "prev_1", span)):
            metrics.append(("op", "o", feed, sig, sel))
            reps.append(("o", feed, sig, dt.date(2026, 1, 1) - dt.timedelta(days=day)))
    m = spark.createDataFrame(metrics, "operator_id STRING, organization_id STRING, feed_id STRING, timetable_signature STRING, version_selector STRING")
    r = spark.createDataFrame(reps, "organization_id STRING, feed_id STRING, timetable_signature STRING, effective_start DATE")
    states = spark.createDataFrame([("o", "f1", 2), ("o", "f2", 2)], "organization_id STRING, feed_id STRING, distinct_timetable_generations BIGINT")
    done = spark.createDataFrame(
        [("o", f, ended, False, False) for f in ("f1", "f2")],
        "organization_id STRING, feed_id STRING, terminal_404 BOOLEAN, api_error BOOLEAN, depth_capped BOOLEAN",
    )
    return history.operator_history(pairs, m, r, states, done).first()


def test_three_valued_flags(spark):
    assert flags(spark, True).years_2plus_all_feeds is False
    assert flags(spark, False).years_2plus_all_feeds is None
    both = flags(spark, False, (800, 900))
    assert both.years_2plus_all_feeds is True and both.history_status == "history_exhaustion_unconfirmed"


def test_yoy_gap_bounds(spark):
    rows = []
    for i, gap in enumerate((364, 365, 455, 456)):
        now = dt.date(2026, 1, 1)
        rows += [(f"op{i}", "o", "f", "A", "current", now, 10.0, 1.0, None),
                 (f"op{i}", "o", "f", "B", "prev_1", now - dt.timedelta(days=gap), 8.0, 1.0, 1.0)]
    m = spark.createDataFrame(rows, "operator_id STRING, organization_id STRING, feed_id STRING, timetable_signature STRING, version_selector STRING, generation_effective_start DATE, weekday_trips_per_day_avg DOUBLE, weekday_trip_hours_per_day_approx DOUBLE, weekday_km_per_day_straight_line_approx DOUBLE")
    pairs = m.select("operator_id", "organization_id", "feed_id").distinct()
    got = {r.operator_id: r for r in history.supply_yoy(pairs, history.yoy_interval_pair(m)).collect()}
    assert [got[f"op{i}"].gtfs_supply_yoy_computable for i in range(4)] == [False, True, True, False]
    assert got["op1"].weekday_trips_yoy_pct == 25.0 and got["op1"].weekday_straight_line_km_yoy_pct is None


def test_digest_sees_content_only(spark):
    rows = [(1, "a"), (2, None), (3, "c")]
    def d(r, cols=("x", "y")):
        df = spark.createDataFrame(r, "x INT, y STRING").select(*cols).repartition(3)
        return digest.table_digest(df).first().digest
    base = d(rows)
    assert base == d(rows[::-1]) == d(rows, ("y", "x"))
    assert len({base, d(rows + rows[:1]), d([(1, "a"), (2, "b"), (3, "c")])}) == 3
