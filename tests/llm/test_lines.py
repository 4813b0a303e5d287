"""Line dedup against plain counting; inserts and deletes against an index built anew."""

import hashlib
import random

import numpy as np

from taktline.llm import chunks, lines
from taktline.llm.cuckoo import CuckooFilter
from taktline.workspace import Workspace

SCHEMA = "doc_id long, text string, shard int"
BLANKS = " \t\n\x0b\x0c\r"


def key_of(line):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(BLANKS))


def stays(docs, min_docs=5, min_chars=40):
    holders = {}
    for i, (doc, text) in enumerate(docs):
        for line in (text or "").split("\n"):
            if len(key_of(line)) >= min_chars:
                holders.setdefault(key_of(line), {})[i] = -(2**63) if doc is None else doc
    top = {k: max(v.values()) for k, v in holders.items() if len(v) >= min_docs}
    return [[key_of(x) not in top or top[key_of(x)] == (-(2**63) if doc is None else doc) for x in (text or "").split("\n")] for doc, text in docs]


def kept_texts(docs):
    return {doc: "\n".join(x for x, s in zip((text or "").split("\n"), own) if s) for (doc, text), own in zip(docs, stays(docs))}


def expected(docs):
    out = []
    for (doc, text), own in zip(docs, stays(docs)):
        kept = "\n".join(x for x, s in zip((text or "").split("\n"), own) if s)
        out.append((doc, len(own), len(own) - sum(own), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def made_up(seed, n=80):
    rng = random.Random(seed)
    shared = [f"Shared line number {i} with quite a few characters in it, größer" for i in range(8)] + ["short line"]
    docs = []
    for i in range(n):
        own = [f"own line {i} {j} " * rng.randint(1, 5) for j in range(rng.randint(0, 3))]
        for s in rng.sample(shared, rng.randint(0, 4)):
            own.insert(0, rng.choice(["", "  ", "\t"]) + (s.upper() if s.isascii() and rng.random() < 0.3 else s) + rng.choice(["", " ", "\r"]))
        docs.append((i, "\n".join(own)))
    return docs


def key(row):
    return tuple((x is None, x or 0) for x in row)


def same(index, docs):
    assert sorted(map(tuple, index.report().collect()), key=key) == sorted(expected(docs), key=key)


def test_cases(spark):
    docs = made_up(1) + [(200, None), (201, ""), (202, "\n\n"), (None, made_up(1)[5][1]), (None, "x" * 90), (7, made_up(1)[7][1])]
    docs += [(300 + i, "a line that only repeated rows of one text have, again and again") for i in range(4)] + [(303, "a line that only repeated rows of one text have, again and again")]
    docs += [(400, "y" * 200_000)]
    df = chunks.prepare(spark).createDataFrame([(d, t, 3) for d, t in docs], SCHEMA).repartition(4)
    index = lines.LineIndex.create(df, Workspace(spark))
    same(index, docs)
    got = index.cleaned(df.schema).collect()
    assert all(r.shard == 3 for r in got) and len(got) == len(docs)


def test_insert_and_delete(spark):
    docs = made_up(2)
    frame = lambda rows: chunks.prepare(spark).createDataFrame([(d, t, 0) for d, t in rows], SCHEMA).repartition(3)
    index = lines.LineIndex.create(frame(docs[:40]), Workspace(spark))
    same(index, docs[:40])
    more = index.insert(frame(docs[40:]))
    same(more, docs)
    gone = {79, 78, 60, 3, 4, 5, 41}
    less = more.delete(spark.createDataFrame([(d,) for d in gone], "doc_id long"))
    same(less, [d for d in docs if d[0] not in gone])
    back = less.insert(frame([d for d in docs if d[0] in gone]))
    same(back, docs)


def test_empty(spark):
    assert lines.LineIndex.create(spark.createDataFrame([], SCHEMA), Workspace(spark)).report().count() == 0


def test_cuckoo_filter():
    rng = np.random.default_rng(1)
    keys = np.unique(rng.integers(0, 2**63, 5000).astype(np.uint64))
    bits = CuckooFilter.build(keys)
    assert bits.contains(keys).all()
    other = rng.integers(2**63, 2**64, 20000, dtype=np.uint64)
    assert bits.contains(other).mean() < 0.01
    bits.delete(keys[:2500])
    assert bits.contains(keys[2500:]).all() and bits.contains(keys[:2500]).mean() < 0.02
