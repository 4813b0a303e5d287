"""Packing: tokens against the tokenizer, places against the rules of a packing, number of sequences against best fit."""

import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

from taktline.llm import packing
from taktline.workspace import Workspace

SCHEMA = "doc_id long, text string, piece string"


@pytest.fixture(scope="module")
def tokenizer():
    t = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    t.encode_special_tokens = True
    return t


def expected(tokenizer, docs, capacity):
    out = []
    for doc, text in docs:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]
        for k, at in enumerate(range(0, len(ids), capacity)):
            part = ids[at : at + capacity]
            out.append((doc, k, at, len(part), zlib.crc32(np.array(part, "<u4").tobytes())))
    return out


def key(row):
    return tuple((x is None, x or 0) for x in row)


def check(rows, want, capacity):
    assert sorted((tuple(r[:5]) for r in rows), key=key) == sorted(want, key=key)
    bins = defaultdict(list)
    for r in rows:
        bins[r.sequence_id].append((r.offset, r.length))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(bins)


TEXTS = [None, "", "  ", "Hello World", "İstanbul ΣΑΣ é é don't DON'T 12345", "a\x1cb\x85c\xa0d", "漢字 <|endoftext|> x", "word " * 900, "Straße, über!", "🙂 ok"]


def test_pieces_and_places(spark, tokenizer):
    docs = [(i, t) for i, t in enumerate(TEXTS)] + [(3, TEXTS[3]), (None, "no id")] + [(100 + i, "some words of text " * (i % 37)) for i in range(300)]
    df = spark.createDataFrame([(d, t, "x") for d, t in docs], SCHEMA).repartition(3)
    rows = packing.pack_documents(df, Workspace(spark), capacity=128, island=50).collect()
    want = expected(tokenizer, docs, 128)
    n = check(rows, want, 128)
    lengths = [w[3] for w in want]  # about as few as best fit over all pieces at once, though an island has 50
    assert n <= 1.03 * len(packing.best_fit(np.argsort(-np.array(lengths), kind="stable"), lengths, 128).items) + 1


def test_empty(spark):
    assert packing.pack_documents(spark.createDataFrame([], SCHEMA), Workspace(spark)).count() == 0


def test_crossover_keeps_every_piece():
    rng = np.random.default_rng(1)
    lengths = rng.integers(1, 90, 400).tolist()
    a, b = (packing.best_fit(rng.permutation(400), lengths, 100) for _ in range(2))
    child = packing.crossover(a, b.items[:30], lengths)
    assert sorted(i for items in child.items for i in items) == list(range(400))
    assert all(sum(lengths[i] for i in items) == fill <= 100 for items, fill in zip(child.items, child.fill))
    assert all(items in child.items for items in b.items[:30])
    first = packing.best_fit(np.argsort(-np.array(lengths), kind="stable"), lengths, 100)
    assert len(packing.evolve(lengths, [], 100, 7).items) <= len(first.items)


def test_foreign_bins_use_own_pieces():
    assert packing.realise([[5, 3], [5, 5], [3]], [3, 5, 5]) == [[2, 0]] or packing.realise([[5, 3], [5, 5], [3]], [3, 5, 5])[0] == [2, 0]


def test_query(spark, tokenizer):
    sf = "/root/testdata/sf0.001"
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    want = expected(tokenizer, docs, 4096)
    n = check(packing.op1_best_fit_packing(spark, sf).collect(), want, 4096)
    assert n <= -(-sum(w[3] for w in want) // 4096) + 1
