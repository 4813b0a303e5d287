"""Headway against route-days one by one, with as many day sets as days."""

import datetime as dt
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from taktline.operators import calendar as cal
from taktline.operators.service import ServiceModel

KEY = ("o", "f", "current", "a")
DAYS = [dt.date(2026, 1, 1) + dt.timedelta(days=i) for i in range(365)]


@pytest.mark.parametrize("totals_known", (False, True))
def test_headway_of_an_agency_with_a_day_set_per_day(spark, totals_known):
    rng = random.Random(2)
    # Each day has a service of its own on one route; three services run on the other route.
    services = {f"d{i}": [day] for i, day in enumerate(DAYS)} | {f"w{k}": DAYS[k::3] + DAYS[:5] for k in range(3)}
    spans = [(*KEY, s, "own" if s[0] == "d" else "shared", rng.randrange(100) * 60) for s in services for _ in range(4)]
    schema = "organization_id string, feed_id string, version_selector string, "
    model = ServiceModel(None)
    model.agency_services = spark.createDataFrame([(*KEY, s, 4) for s in services], schema + "agency_id string, service_id string, trips long")
    model.service_days = spark.createDataFrame([(*KEY[:3], s, sorted(set(d))) for s, d in services.items()], schema + "service_id string, days array<date>")
    model.spans = spark.createDataFrame(spans, schema + "agency_id string, service_id string, route_id string, first_sec long")
    model.bus_trips = model.spans
    if totals_known:
        model.day_totals = model.day_sets()
    times = defaultdict(set)
    for *_, service, route, sec in spans:
        for day in set(services[service]):
            times[route, day].add(sec)
    gaps = [(max(t) - min(t)) / (len(t) - 1) / 60 for t in times.values() if len(t) > 1]
    row = model.route_headway().first()
    assert row.route_days == len(gaps) and row.mean_headway_min == pytest.approx(sum(gaps) / len(gaps))


def _two_agencies(spark):
    """Two services on one agency, one of them also on another agency that has no days besides."""
    schema = "organization_id string, feed_id string, version_selector string, "
    model = ServiceModel(None)
    days = {"s1": DAYS[:10], "s2": DAYS[5:40:3]}
    other = (*KEY[:3], "b")
    totals = [(*KEY, "s1", 2, 7200, 1.5, 100, 9000), (*KEY, "s2", 3, 3600, 2.0, None, None), (*other, "s2", 1, 60, 0.5, 50, 70), (*other, "s3", 1, 60, 0.5, 1, 99999)]
    columns = schema + "agency_id string, service_id string, trips long, seconds long, km double, first_sec long, last_sec long"
    model.service_totals = spark.createDataFrame(totals, columns)
    model.service_days = spark.createDataFrame([(*KEY[:3], s, d) for s, d in days.items()], schema + "service_id string, days array<date>")
    model.window = spark.createDataFrame([(*KEY[:3], DAYS[0], DAYS[99], True)], schema + "window_start date, window_end date, has_calendar boolean")
    model.bus_routes = spark.createDataFrame([KEY, other], schema + "agency_id string")
    return model, days, totals


def test_days_are_counted_without_making_them(spark):
    model, days, totals = _two_agencies(spark)
    averages = model.weekday_weekend_avg()
    for r in averages.collect():
        own = [t for t in totals if t[3] == r.agency_id and t[4] in days]
        run = set().union(*(days[t[4]] for t in own))
        weekdays = [d for d in run if d.weekday() < 5]
        assert (r.operating_days_in_window, r.weekday_operating_days_in_window) == (len(run), len(weekdays))
        trips = sum(t[5] for t in own for d in days[t[4]] if d.weekday() < 5)
        assert r.weekday_trips_avg == pytest.approx(trips / sum(d.weekday() < 5 for d in DAYS[:100]))
    # Generate makes days; only the window of an archive and the small table of services may need any.
    assert "Generate" not in averages._jdf.queryExecution().executedPlan().toString()
    assert {r.agency_id: (r.first_sec, r.last_sec) for r in model.first_last_service_time().collect()} == {"a": (100, 9000), "b": (50, 70)}


def test_days_are_dealt_by_agency_before_they_are_made(spark):
    model, days, totals = _two_agencies(spark)
    daily = model.daily_service()
    got = {(r.agency_id, r.day): (r.trips, r.hours, r.km) for r in daily.collect()}
    want = {(a, d): (0, 0, 0) for a in "ab" for d in DAYS[:100]}
    for t in totals:
        for d in days.get(t[4], []):
            x = want[t[3], d]
            want[t[3], d] = (x[0] + t[5], x[1] + t[6] / 3600, x[2] + t[7])
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)
    plan = daily._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan[: plan.index("Generate")]


def test_bits_of_a_window_do_not_meet(spark):
    days = [dt.date(2024, 12, 30) + dt.timedelta(days=i) for i in range(2 * 365 + 1)]
    words = spark.createDataFrame([(days,)], "days array<date>").select(*cal.day_words(F.col("days"))).first()
    assert sum(w.bit_count() for w in words) == len(days)
    assert sum((w & cal.WORD_WEEKDAYS).bit_count() for w in words) == sum(d.weekday() < 5 for d in days)
