"""Quality rules: counts against plain Python, defined cases, what the rules keep."""

import re
from collections import Counter

import duckdb

from taktline.llm import chunks, quality

SCHEMA = "doc_id long, text string, kept string"
CLEAN = "A plain sentence with words that are all different, and an end.\nAnother one follows here, quite short."


def counts(text):
    text = text or ""
    words = re.findall("[^\x20\x09-\x0d]+", text)
    lines = [x for x in text.split("\n") if re.search("[^\x20\x09-\x0d]", x)]
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    times = Counter(windows)
    covered = {i + j for i, w in enumerate(windows) if times[w] > 1 for j in range(5)}
    failed = len(words) < 10 or 100 * len(covered) > 20 * len(words)
    return len(words), sum(map(len, words)), len(re.findall("[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), failed


def test_counts_and_cases(spark):
    docs = [(1, CLEAN), (2, None), (3, ""), (4, " \n\t\n"), (5, "one two three four five " * 6), (6, CLEAN + "\n" + CLEAN), (7, "größe # * $ <b>\x1f x\xa0y"), (None, CLEAN), (1, CLEAN), (8, "word " * 100_000)]
    got = quality.quality_report(chunks.prepare(spark).createDataFrame([(d, t, "x") for d, t in docs], SCHEMA)).collect()
    key = lambda r: tuple((x is None, x or 0) for x in r)
    assert sorted((tuple(r[:7]) for r in got), key=key) == sorted(((d, *counts(t)) for d, t in docs), key=key)
    assert {r.doc_id for r in got if r.kept} == {1, 6, None} or {r.doc_id for r in got if r.kept} == {1, None}


def test_lines():
    fails = lambda line: quality.line_fails(line.encode())
    assert fails("Home | About | Contact") and fails("Buy*** now### cheap%%% pills$$$") and fails("BUY!! NOW!! CHEAP!!") and fails("All rights reserved.")
    assert fails("Home") and fails("word " * 80)
    assert not any(map(fails, CLEAN.split("\n"))) and not fails("It costs 5 $ or so, he said.") and not fails("Wait! Stop! He ran on, and on.")


def test_lost_text_and_kept_text(spark):
    junk = "Home | About | Contact | More | Links | Here | There | Up | Down | Out"
    docs = [(1, CLEAN + "\nAll rights reserved."), (2, CLEAN + "\n" + "\n".join([junk + str(i) for i in range(5)])), (3, CLEAN)]
    df = chunks.prepare(spark).createDataFrame([(d, t, "x") for d, t in docs], SCHEMA)
    assert {r.doc_id: r.text for r in quality.keep_good(df).collect()} == {1: CLEAN, 3: CLEAN}


def test_web_boilerplate_is_lost_text():
    kept = lambda text: quality.judge(text.encode())[6]
    web = [f"{x} number {i} of this long page" for i, x in enumerate(("Click here for", "Log in to see", "Please enable JavaScript for", "Share this with", "Sign up for", "This site uses cookies for") * 4)]
    assert not kept("\n".join([*web, CLEAN])) and not kept(CLEAN + "\n" + "\n".join(f"All rights reserved, {x}" for x in web))
    assert kept(CLEAN + "\n" + web[0]) and kept("A short text of ten words stands here, and no more.\nReleased under the terms of a licence that has a rather long name, all rights reserved by us.")


RULES = [
    "All rights reserved by the owner of a rather long name here.\nReleased under the terms of some licence.\nok fine.",
    "Released under the terms of some licence.\nA line of just ten words stands in the text here.",
    "All rights reserved, click here to read on.\n" + CLEAN, "好的。\n" + CLEAN, "好的：\n" + CLEAN, "Home\n" + CLEAN]


def test_one_licence_line_is_no_loss_and_wide_marks_end_a_line():
    assert [quality.judge(t.encode())[6] for t in RULES] == [False, True, True, True, True, True]
    assert [quality.judge(t.encode())[7] for t in RULES] == [2, 1, 1, 0, 0, 1]


def test_sql_states_the_rules_that_given_rows_do_not_show(spark):
    con = duckdb.connect()
    con.sql("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", list(enumerate(RULES)))
    want = con.sql(quality.SQL).order("doc_id").project("doc_id, kept, n_lines_removed, lost_chars").fetchall()
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(RULES)], SCHEMA)
    got = quality.quality_report(df).select("doc_id", "kept", "n_lines_removed", "lost_chars").orderBy("doc_id").collect()
    assert [tuple(r) for r in got] == want


def test_empty(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert quality.quality_report(df).count() == 0 and quality.keep_good(df).count() == 0


def test_clean_labels_are_kept(spark):
    sf = "/root/testdata/sf0.01"
    got = {r.doc_id: r for r in quality.op2_quality_rules(spark, sf).collect()}
    labels = spark.read.parquet(f"{sf}/labels.parquet").collect()
    clean = [got[r.doc_id] for r in labels if r.quality == 1 and not got[r.doc_id].base_failed]
    junk = [got[r.doc_id] for r in labels if r.quality == 0]
    assert all(r.kept for r in clean) and sum(r.kept for r in junk) <= 0.05 * len(junk)
