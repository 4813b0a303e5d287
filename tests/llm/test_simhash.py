"""Fingerprints: order and edits against plain Python, near pairs against all pairs, likeness on real texts."""

import hashlib
from itertools import combinations

from taktline.llm import simhash
from taktline.workspace import Workspace

SCHEMA = "doc_id long, text string, fingerprint int"


def expected(docs):
    rows = sorted(((d, t or "") for d, t in docs), key=lambda r: -r[0])
    out = []
    for (doc, text), (_, after) in zip(rows, rows[1:] + rows[:1]):
        n = len(text) // 3
        changed = text[: len(text) - n] + after[:n]
        own, other = simhash.fingerprint(text), simhash.fingerprint(changed)
        out.append((doc, len(text), hashlib.sha256(changed.encode()).hexdigest(), own.hex(), other.hex(), simhash.likeness(own, other), simhash.likeness(own, simhash.fingerprint(after))))
    return out


def test_next_in_order(spark):
    docs = [(i * 7 % 101, f"text number {i} " + "größe word " * (i % 9)) for i in range(101)] + [(500, None), (501, ""), (502, "x"), (503, "x" * 5000)]
    df = spark.createDataFrame([(d, t, 1) for d, t in docs], SCHEMA).repartition(5)
    assert sorted(map(tuple, simhash.compare_edited(df, Workspace(spark)).collect())) == sorted(expected(docs))


def test_few_rows(spark):
    for docs in ([], [(1, "only one text")], [(1, "a b c"), (2, "d e f")]):
        df = spark.createDataFrame([(d, t, 1) for d, t in docs], SCHEMA)
        assert sorted(map(tuple, simhash.compare_edited(df, Workspace(spark)).collect())) == sorted(expected(docs))


def test_ties_and_null_ids(spark):
    df = spark.createDataFrame([(None, "a", 1), (None, None, 1), (4, "same", 1), (4, "same", 1), (4, "other", 2)], SCHEMA)
    got = simhash.compare_edited(df, Workspace(spark)).collect()
    assert sorted(str(r.doc_id) for r in got) == ["4", "4", "4", "None", "None"]
    same = {r.fingerprint for r in got if r.doc_id == 4 and r.n_chars == 4}
    assert len(same) == 1


def test_radius_finds_all_pairs(spark):
    base = int.from_bytes(simhash.fingerprint("some words to start from here"))
    prints = {base}
    for i in range(60):
        prints.add(base ^ (1 << (i * 5 % 128)) ^ (1 << (i * 11 % 128)) ^ (1 << (i * 3 % 128)))
    prints |= {int.from_bytes(simhash.fingerprint(f"far away {i}")) for i in range(20)}
    hexes = [f"{p:032x}" for p in prints]
    want = {(min(a, b), max(a, b), d) for a, b in combinations(hexes, 2) if (d := (int(a, 16) ^ int(b, 16)).bit_count()) <= 3}
    df = spark.createDataFrame([(i, h) for i, h in enumerate(hexes + hexes[:5])] + [(99, None)], "doc_id long, fingerprint string")
    assert {tuple(r) for r in simhash.within_radius(df, 3).collect()} == want and want


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    got = simhash.op8_document_fingerprints(spark, sf).collect()
    assert sorted(map(tuple, got)) == sorted(expected(docs))
    long = [r for r in got if r.n_chars > 500]
    assert sum(r.near_edited > r.near_next + 0.2 for r in long) > 0.9 * len(long)
