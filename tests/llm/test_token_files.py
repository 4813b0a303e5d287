import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from taktline.llm.perfect_hash import PerfectHash, fingerprints, key_hashes
from taktline.llm.token_files import Shard, TokenFiles, UnitEncoder, op12_token_files
from taktline.workspace import Workspace

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def tokenizer():
    made = Tokenizer.from_file(PATH)
    made.encode_special_tokens = True
    return made


@pytest.fixture(scope="module")
def encoder():
    return UnitEncoder(PATH, "<u2")


def expected(rows, tokenizer):
    out, start = [], 0
    for key, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [0]
        out.append((key, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from("ab '\n\t\r.,1é\x1c\x85\xa0 ​　漢😀st"), max_size=30) | st.text(max_size=40))
def test_units_give_the_ids_of_the_library(tokenizer, encoder, text):
    assert np.frombuffer(encoder.encode_all([text])[0], "<u2").tolist() == tokenizer.encode(text, add_special_tokens=False).ids


def test_special_strings_are_ordinary_text(tokenizer, encoder):
    text = "a <|endoftext|> b"
    ids = np.frombuffer(encoder.encode_all([text])[0], "<u2").tolist()
    assert 50256 not in ids and ids == tokenizer.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("n", [0, 1, 2, 1000, 50_000])
def test_hash_is_minimal_and_perfect(n):
    keys = np.arange(n) * 7 - 1000
    hashes = key_hashes(keys, np.zeros(n, np.int64), np.zeros(n, bool))
    found = PerfectHash.build(*hashes)
    assert sorted(found.index(*hashes).tolist()) == list(range(n))
    if n == 50_000:
        assert len(found.words) * 64 < 6 * n
        other = key_hashes(keys + 1, np.zeros(n, np.int64), np.zeros(n, bool))
        at, mark = found.index(*other), np.zeros(n, np.uint32)
        mark[found.index(*hashes)] = fingerprints(*hashes)
        known = np.isin(keys + 1, keys)
        assert ((at >= 0) & (mark[at] == fingerprints(*other)))[~known].sum() <= 2


def test_equal_keys_are_refused():
    hashes = key_hashes(np.zeros(2, np.int64), np.zeros(2, np.int64), np.zeros(2, bool))
    with pytest.raises(ValueError):
        PerfectHash.build(*hashes)


def test_query_equals_brute_force(spark, tokenizer):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    got = op12_token_files(spark, sf).select("doc_id", "start", "n_tokens", "ids_crc32").orderBy("start").collect()
    assert [tuple(r) for r in got] == expected(rows, tokenizer)


def test_keyed_access_with_ids(spark, tokenizer):
    """Small shards: a doc_id with a third of all rows stands in many of them; null, repeated and unknown keys."""
    rows = [(i, f"text {i} " * (i % 5)) for i in range(-20, 40)] + [(7, f"again {i % 9}") for i in range(40)] + [(None, "x"), (None, None), (50, None), (51, "")]
    docs = spark.createDataFrame([(k, t, "z", 1) for k, t in rows], "doc_id int, text string, shard string, row int")
    files = TokenFiles(spark, f"{Workspace(spark).folder}/t").write(docs, PATH, shard_ids=24)
    assert files.documents().select("shard").distinct().count() > 10
    keys = spark.createDataFrame([(7,), (7,), (None,), (39,), (50,), (12345,)], "doc_id long")
    got = files.fetch(keys).collect()
    assert len(got) == sum(k in (7, None, 39, 50) for k, _ in rows)
    for r in got:
        assert tokenizer.decode(r.ids[:-1]) in {t or "" for k, t in rows if k == r.doc_id} and r.ids[-1] == 0
        assert r.n_tokens == len(r.ids) and r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
    whole = sorted(files.fetch(docs, ids=False).collect(), key=lambda r: r.start)
    assert len(whole) == len(rows)
    assert [r.start for r in whole] == np.cumsum([0, *(r.n_tokens for r in whole)])[:-1].tolist()
    assert [r.doc_id for r in whole] == sorted((k for k, _ in rows), key=lambda k: (k is not None, k or 0))


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    files = TokenFiles(spark, f"{Workspace(spark).folder}/t").write(docs, PATH)
    assert files.fetch(docs).count() == 0 and files.documents().count() == 0


def test_broken_files_are_errors(spark):
    files = TokenFiles(spark, f"{Workspace(spark).folder}/t").write(spark.createDataFrame([(1, "a b c")], "doc_id long, text string"), PATH)
    data = bytes(spark.read.format("binaryFile").load(f"{files.folder}/ids").filter(F.col("length") > 0).first().content)
    assert Shard(data).ids.tolist()[-1] == 0
    for bad in (data[:-1], data + b"x", b"X" + data[1:]):
        with pytest.raises(ValueError):
            Shard(bad)
