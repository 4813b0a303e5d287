import datetime as dt

import pytest
from pyspark.sql import functions as F

from taktline import functions as fn


def test_normalize_name(evaluate):
    names = ["（株）ＡＢＣ　バス", "㈱伊予鉄バス", "バス５号", None, "(株式会社株)", " a\tb　", "plain Bus"]
    assert evaluate(fn.normalize_name, names) == ["ABCバス", "伊予鉄バス", "バス5号", "", "", "ab", "plainBus"]
    kept = evaluate(lambda c: fn.normalize_name(c, remove_legal=False), ["㈱伊予鉄"])
    assert kept == ["(株)伊予鉄"]


def test_operator_id(evaluate):
    assert evaluate(fn.operator_id, ["ABCバス|op1.example.jp"]) == ["55548de4117f95f7"]


def test_url_host(evaluate):
    urls = ["https://www.Example.com/a", "example.com", "http://a_b.jp/x", "http://u:p@w.jp:80", "", None]
    assert evaluate(fn.url_host, urls) == ["example.com", "", "a_b.jp", "w.jp", "", ""]


def test_canonical_operator(evaluate):
    key = evaluate(
        lambda c: fn.canonical_operator(c, F.lit(""), F.lit("愛媛県"), F.lit("o1")), ["バス 株式会社"]
    )
    assert key == ["バス|publisher:o1|pref:愛媛県"]


def test_times(evaluate):
    assert evaluate(fn.gtfs_seconds, ["25:10:05", "8:05", "x", None, " 8:05:00 "]) == [90605, None, None, None, 29100]
    assert evaluate(fn.fmt_time, [90605, 0, None], "bigint") == ["25:10", "00:00", ""]


def test_dates(evaluate):
    three = evaluate(fn.parse_date3, ["20260929", "2026/09/29", "2026-9-9", "x", None, " 2026-09-29 "])
    d = dt.date(2026, 9, 29)
    assert three == [d, d, dt.date(2026, 9, 9), None, None, d]
    assert evaluate(fn.parse_date2, ["20260929", "2026/09/29"]) == [d, None]


def test_haversine(evaluate):
    km = evaluate(lambda c: fn.haversine_km(F.lit(0.0), F.lit(0.0), F.lit(0.0), c), [1.0, None], "double")
    assert km[0] == pytest.approx(111.1950802, abs=1e-6) and km[1] is None
    near = evaluate(lambda c: fn.haversine_km(F.lit(33.84), F.lit(132.76), F.lit(33.85), c), [132.77], "double")
    assert near[0] == pytest.approx(1.4454543, abs=1e-6)


def test_is_bus_route(evaluate):
    codes = ["3", "11", "700", "799", "800", "2", "x", None, " 3 "]
    assert evaluate(fn.is_bus_route, codes) == [True] * 4 + [False] * 4 + [True]


def test_has_value_and_truth(evaluate):
    assert evaluate(fn.has_value, ["-", "－", "NA", "null", "0", None, " "]) == [False] * 4 + [True, False, False]
    assert evaluate(fn.truth, ["True", "1", "no", None]) == [True, True, False, False]


def test_seq_ratio(spark):
    pairs = [("伊予鉄バス", "伊予鉄道"), ("松山バス", "東京バス"), ("tide", "diet"), ("diet", "tide")]
    df = spark.createDataFrame(pairs, "a STRING, b STRING").select(fn.seq_ratio(F.col("a"), F.col("b")).alias("r"))
    assert [round(r.r, 4) for r in df.collect()] == [0.6667, 0.5, 0.25, 0.5]


def test_prefecture_and_selector(evaluate):
    assert evaluate(fn.prefecture_name, [1, 38, 47, 99, 0, 48, None], "int") == [
        "北海道", "愛媛県", "沖縄県", "全国", "不明", "不明", "不明"
    ]
    assert evaluate(fn.selector_no, ["current", "prev_12", "odd", None]) == [0, 12, 999, 999]


def test_file_names(evaluate):
    cds = ['attachment; filename="a_20240401_20240328120000.zip"; x=1', "", None]
    names = evaluate(lambda c: fn.disposition_filename(c, F.lit("d/b_20230101_20221231000000.zip")), cds)
    assert names == ["a_20240401_20240328120000.zip"] + ["b_20230101_20221231000000.zip"] * 2
    assert evaluate(fn.effective_date, names[:1] + ["x.zip", "a_20241399_20240328120000.zip"]) == [
        dt.date(2024, 4, 1), None, None
    ]
    assert evaluate(fn.upload_datetime, names[:1]) == [dt.datetime(2024, 3, 28, 12)]


def test_rates(evaluate):
    assert evaluate(lambda c: fn.safe_rate(F.lit(1), c), [3, 0], "int") == [0.3333, None]
    assert evaluate(lambda c: fn.pct_change(c, F.lit(8.0)), [10.0, None], "double") == [25.0, None]
    assert evaluate(lambda c: fn.pct_change(c, F.lit(0.0)), [10.0], "double") == [None]


def test_split_pairs(evaluate):
    got = evaluate(fn.split_pairs, ["a/b|c/d/e|x", None])
    assert [[tuple(p) for p in cell] for cell in got] == [[("a", "b"), ("c", "d/e")], []]
