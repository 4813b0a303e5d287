"""Byte-level BPE against the tiktoken library."""

import base64
import hashlib

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken

from taktline.llm import bpe
from taktline.workspace import Workspace

SCHEMA = "doc_id long, text string, ids string"


@pytest.fixture(scope="module")
def plain():
    with open(P.path("byte_bpe_multi_50k.tiktoken"), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("plain", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def expected(plain, doc, text):
    ids = plain.encode_ordinary(text or "")
    return (doc, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest())


TEXTS = [
    None, "", " ", "\n\n  \n", "It's 12 o'clock, isn't it?  we'll  see'", "ünïcödé — 漢字かな 🙂🙂", "x" * 700, "ab" * 400 + " the end",
    "word " * 300, " " * 500 + "a" + " " * 300, "tab\tand\r\nlines\n" * 40, "don't re're 's'll " * 40, "1234567890" * 60 + "a1b2" * 60,
]


@pytest.mark.parametrize("chunk,overlap", [(64, 16), (100, 37), (1 << 16, 1 << 10)])
def test_same_as_library(spark, plain, chunk, overlap):
    rows = [(i, t, "x") for i, t in enumerate(TEXTS)] + [(3, TEXTS[4], "y"), (None, "no id", None)]
    got = bpe.encode_digests(spark.createDataFrame(rows, SCHEMA), Workspace(spark), chunk_chars=chunk, overlap=overlap).collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[2])
    assert sorted(map(tuple, got), key=key) == sorted((expected(plain, i, t) for i, t, _ in rows), key=key)


def test_empty(spark):
    assert bpe.encode_digests(spark.createDataFrame([], SCHEMA), Workspace(spark)).count() == 0


def test_merges_agree():
    make = bpe.encoder(None, None)
    for text in ("hello", "überraschung" * 9, "aaaaaaaaab" * 30, "the the"):
        assert bpe.merge_short(text.encode(), make.ranks) == bpe.merge_long(text.encode(), make.ranks)


def test_query(spark, plain):
    sf = "/root/testdata/sf0.001"
    want = sorted(expected(plain, r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect())
    assert sorted(map(tuple, bpe.op5_byte_bpe(spark, sf).collect())) == want
