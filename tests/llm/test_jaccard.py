"""Components of similar documents against all pairs."""

import random
from itertools import combinations

import pytest

from taktline.llm import chunks, jaccard
from taktline.llm.components import components
from taktline.workspace import Workspace

SCHEMA = "doc_id long, text string, n string"


def shingle_set(text, width=4):
    words = (text or "").encode().lower().split()
    return frozenset(tuple(words[i : i + width]) for i in range(len(words) - width + 1)) or frozenset([tuple(words)] if words else [])


def expected(docs, percent=85, width=4):
    sets = [shingle_set(t, width) for _, t in docs]
    top = list(range(len(docs)))

    def find(i):
        while top[i] != i:
            top[i] = top[top[i]]
            i = top[i]
        return i

    by = {}
    for i, s in enumerate(sets):
        for x in s:
            by.setdefault(x, []).append(i)
    for i, j in {p for group in by.values() for p in combinations(group, 2)}:
        common = len(sets[i] & sets[j])
        if common and 100 * common >= percent * len(sets[i] | sets[j]):
            top[find(i)] = find(j)
    least = {}
    for i, (doc, _) in enumerate(docs):
        least.setdefault(find(i), []).append(doc)
    return [(doc, len(sets[i]), min((d for d in least[find(i)] if d is not None), default=None)) for i, (doc, _) in enumerate(docs)]


def made_up(seed):
    rng = random.Random(seed)
    word = lambda: rng.choice("abcdefghij") + rng.choice("aeiou") + rng.choice("klmnop")
    passage = " ".join(word() for _ in range(40))
    docs = []
    for family in range(6):
        base = [word() for _ in range(rng.randint(20, 120))]
        for _ in range(rng.randint(1, 40)):
            copy = list(base)
            for _ in range(rng.randint(0, 4)):
                copy[rng.randrange(len(copy))] = word()
            if rng.random() < 0.2:
                copy = copy[: -rng.randint(1, 6)]
            docs.append(" ".join(copy).upper() if rng.random() < 0.1 else "  ".join(copy))
    docs += [" ".join(word() for _ in range(60)) + " " + passage for _ in range(40)]
    docs += [None, "", " \n", "one", "One", "one two three", "one two three four", "one two three four five", "a b c"]
    rng.shuffle(docs)
    return [(1000 - i, t) for i, t in enumerate(docs)] + [(5, docs[3]), (None, docs[5]), (None, "alone without id here now")]


@pytest.mark.parametrize("seed", [1, 2])
def test_all_pairs(spark, seed):
    docs = made_up(seed)
    df = chunks.prepare(spark).createDataFrame([(d, t, "x") for d, t in docs], SCHEMA).repartition(4)
    key = lambda r: tuple((x is None, x or 0) for x in r)
    got = sorted((tuple(r) for r in jaccard.similar_components(df, Workspace(spark)).collect()), key=key)
    assert got == sorted(expected(docs), key=key)


def test_one_of_each(spark):
    docs = made_up(3)
    df = chunks.prepare(spark).createDataFrame([(d, t, "x") for d, t in docs], SCHEMA).repartition(3)
    got = jaccard.one_of_each(df, Workspace(spark), 5, 80).collect()
    want = {}
    for i, (doc, _, comp) in enumerate(expected(docs, 80, 5)):
        text = (docs[i][1] or "").split()
        want.setdefault((comp is None and i, comp) if text else ("empty", i), []).append(doc)
    assert len(got) == len(want)
    ids = sorted(r.doc_id for r in got if r.doc_id is not None and (r.text or "").split())
    assert ids == sorted(min(d for d in v if d is not None) for k, v in want.items() if k[0] != "empty" and k[1] is not None)


def test_empty(spark):
    assert jaccard.similar_components(spark.createDataFrame([], SCHEMA), Workspace(spark)).count() == 0


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(50)] + [(100, i) for i in range(101, 140)] + [(200, 201), (202, 201)]
    df = spark.createDataFrame(edges, "a long, b long")
    got = {r.node: r.component for r in components(df, Workspace(spark)).collect()}
    assert got == {**{i: 0 for i in range(51)}, **{i: 100 for i in range(100, 140)}, **{i: 200 for i in (200, 201, 202)}}


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted(map(tuple, jaccard.op4_ngram_jaccard_join(spark, sf).collect())) == sorted(expected(docs))
