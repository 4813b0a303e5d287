import difflib
import random
import unicodedata

import pytest
from pyspark.sql import functions as F

from taktline.constants import LEGAL_FORMS
from taktline.operators import funnel
from taktline.operators.matching import Matching, candidate_keys, similar_keys
from taktline.workspace import Workspace

OPS = "operator_id STRING, agency_name STRING, agency_url STRING, prefectures STRING"
LINKS = ("links_operator_id STRING, operator_name STRING, prefecture_address STRING, operator_number STRING, "
         "source_rows BIGINT, row_ix BIGINT")


def names(n, seed):
    random.seed(seed)
    alphabet = "伊予鉄松山東京バス交通観光中央市営abc"
    return ["".join(random.choice(alphabet) for _ in range(random.randrange(1, 9))) + random.choice(["", "バス", "交通"]) for _ in range(n)]


def test_similar_keys_finds_every_pair(spark):
    left, right = sorted(set(names(60, 1))), sorted(set(names(70, 2)))
    want = {}
    for a in left:
        for b in right:
            score = difflib.SequenceMatcher(None, a, b).ratio()
            if score >= 0.55:
                want[a, b] = score
    frames = [spark.createDataFrame([(x,) for x in s], "key STRING") for s in (left, right)]
    got = {(r.l, r.r): r.score for r in similar_keys(*frames, workspace=Workspace(spark)).collect()}
    assert got == pytest.approx(want) and len(want) > 50


def test_few_candidates_and_their_growth(spark):
    """Distinct random names: a small part of all pairs meets, and not the square of their number."""
    rng, found = random.Random(5), {}
    for n in (250, 1000):
        frames = [spark.createDataFrame([("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(12)),) for _ in range(n)], "key STRING") for _ in "lr"]
        found[n] = candidate_keys(*frames, workspace=Workspace(spark)).count()
    assert found[1000] < 0.05 * 1000**2 and found[1000] < 8 * found[250]


def plain_cascade(ops, links, aliases):
    """The rules once more, row by row."""
    def norm(s):
        s = "".join(unicodedata.normalize("NFKC", s).split())
        for form in sorted(LEGAL_FORMS, key=len, reverse=True):
            s = s.replace(unicodedata.normalize("NFKC", form), "")
        return s

    classes, top = {}, {}
    for op, name in ops:
        raw = name.strip()
        exact = [l for l in links if l[1].strip() == raw]
        normal = [l for l in links if norm(l[1]) == norm(raw)]
        if exact:
            chosen = "A" if len({l[0] for l in exact}) == 1 else None
        elif normal:
            chosen = "B" if len({l[0] for l in normal}) == 1 else None
        else:
            chosen = "C" if op in aliases else None
        if chosen:
            classes[op] = chosen
            continue
        scored = [(difflib.SequenceMatcher(None, norm(raw), norm(l[1])).ratio(), l) for l in links]
        scored = sorted((s for s in scored if s[0] >= 0.55), key=lambda s: (-s[0], s[1][1]))
        classes[op] = "D" if scored else "E"
        top[op] = sorted((round(s, 4), l[0]) for s, l in scored[:3])
    return classes, top


def test_cascade_against_plain_rules(spark):
    pool, extra = names(40, 5), names(20, 9)
    random.seed(11)
    links = [(f"L{i % 45}", random.choice(["株式会社", "", "", "㈱"]) + random.choice(pool)) for i in range(60)]
    ops = [(f"op{i}", random.choice(pool + extra) + random.choice(["", " ", "（株）"])) for i in range(60)]
    ops.append(("ops", "QWERTYUIOP"))
    ops.append(("opz", "ZZZZ"))
    link_df = spark.createDataFrame([(*l, "x", "1", 1, i) for i, l in enumerate(links)], LINKS)
    op_df = spark.createDataFrame([(*o, "", "愛媛県") for o in ops], OPS)
    alias = spark.createDataFrame([("ops", "nobody", 1), ("ops", "L3", 2)], "operator_id STRING, links_operator_id STRING, row_ix BIGINT")
    m = Matching(op_df, link_df, alias)
    classes, top = plain_cascade(ops, links, {"ops"})
    assert {r.operator_id: r.match_class for r in m.classes.collect()} == classes
    assert set(classes.values()) == set("ABCDE")
    got = {}
    for r in m.fuzzy_candidates().where("candidate_type = 'fuzzy_review_required'").collect():
        got.setdefault(r.operator_id, []).append((r.score, r.candidate_links_operator_id))
    assert {k: sorted(v) for k, v in got.items()} == {k: v for k, v in top.items() if v}
    summary = {r.match_class: r.confirmed_or_candidate_count for r in m.match_summary().collect()}
    assert sum(summary[c] for c in "ABCDE") == summary["GTFS_total"] == len(ops)


def test_missing_source_is_unknown(spark):
    op_df = spark.createDataFrame([("o1", "バス", "", "愛媛県")], OPS)
    m = Matching(op_df, None)
    assert {r.match_class: r.confirmed_or_candidate_count for r in m.match_summary().collect()} == {
        "A": None, "B": None, "C": None, "D": None, "E": None, "GTFS_total": 1
    }
    assert m.unmatched_left().first().match_class == "not_evaluable"
    matched = spark.createDataFrame([], "operator_id STRING, match_class STRING, links_operator_id STRING, links_operator_name STRING")
    common = spark.createDataFrame([], "links_operator_id STRING, common_links_year STRING, common_permit_type STRING, transport_complete BOOLEAN, driver_complete BOOLEAN")
    history = spark.createDataFrame([], "operator_id STRING, years_2plus_all_feeds BOOLEAN, years_3plus_all_feeds BOOLEAN")
    flags = funnel.operator_flags(op_df, matched, common, history)
    stages = funnel.funnel(flags, available=False).collect()
    assert [s.operator_count for s in stages] == [1] + [None] * 6
    assert {s.status for s in stages[1:]} == {"not_evaluable_LINKS_source_unavailable"}
    assert funnel.verdict(flags, available=False).first().verdict == "FAIL"


def test_operator_in_two_prefectures_counts_in_both(spark):
    flags = spark.createDataFrame([("o", "愛媛県|高知県|不明")], "operator_id STRING, prefectures STRING").withColumns(
        {c: F.lit(False) for c in ("matched", "transport_complete", "overview_present", "driver_complete", "history_2plus", "history_3plus")}
    )
    got = {r.prefecture: r.gtfs_bus_operator_entities for r in funnel.prefecture_summary(flags).collect()}
    assert len(got) == 48 and got["愛媛県"] == got["高知県"] == got["全国・都道府県不明"] == 1 and sum(got.values()) == 3
