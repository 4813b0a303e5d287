"""Every stage of the pipeline against brute force on the rows that it gets."""

import pyarrow as pa

import corpus_pipeline
from taktline.llm import chunks, packing, quality
from tests.llm import test_jaccard, test_lines, test_packing, test_repeats
from tokenizers import Tokenizer
import public_tokenizers


def rows_of(df):
    return {r.doc_id: r for r in df.collect()}


def test_stages(spark):
    sf = "/root/testdata/sf0.001"
    docs = chunks.table(spark, sf, "documents")
    steps = [docs]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        made = stage(spark, steps[-1], sf)
        assert [(f.name, f.dataType) for f in made.schema] == [(f.name, f.dataType) for f in docs.schema]
        steps.append(spark.createDataFrame(made.collect(), docs.schema))
    before, good, lined, single, cut = map(rows_of, steps)
    verdicts = {d: quality.judge((r.text or "").encode()) for d, r in before.items()}
    assert {d: r.text for d, r in good.items()} == {d: v[-1].decode() for d, v in verdicts.items() if v[6]}
    assert {d: r.text for d, r in lined.items()} == test_lines.kept_texts([(d, r.text) for d, r in good.items()])
    comps = jaccard_components([(d, r.text) for d, r in lined.items()])
    assert set(single) == {d for d, c in comps.items() if c == d} and 0 < len(single) < len(lined)
    want = test_repeats.expected([(d, r.text) for d, r in single.items()])
    assert {w[0] for w in want} == set(cut)
    assert all(len(cut[w[0]].text.encode()) <= w[1] - w[2] and cut[w[0]].n_chars == len(cut[w[0]].text) for w in want)
    assert all(r.lang == before[d].lang and r.source == before[d].source for d, r in cut.items())
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    tokenizer.encode_special_tokens = True
    packed = corpus_pipeline.packing_stage(spark, steps[-1], sf).collect()
    test_packing.check(packed, test_packing.expected(tokenizer, [(d, r.text) for d, r in cut.items()], 4096), 4096)


def jaccard_components(docs):
    return {doc: comp for doc, _, comp in test_jaccard.expected(docs, percent=80, width=5)}


def test_run_and_registration(spark):
    import __spark_entry__

    assert "pipeline" in __spark_entry__.queries()
    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert out.count() > 0 and {"doc_id", "piece", "sequence_id", "offset"} <= set(out.columns)


def test_results_of_two_runs_stay(spark, tmp_path):
    sf = str(tmp_path)
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(40).collect()
    text = "A text of its own with some words that stand nowhere else in here, number {}."
    # Nulls in every column, equal rows, repeated ids, columns with names that the stages use themselves.
    more = [(None, "Rows without any number are kept if what they say is said by no other row of the table.", None, None, None), (10**6, None, "en", "a", 0), (10**6, "", "en", "a", 0), (10**6 + 1, text.format(1), "en", "a", 1), (10**6 + 1, text.format(1), "en", "a", 1)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, chunk long, shard string, block int"
    made = [(r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in rows]
    spark.createDataFrame([(*r, 1, "s", 2) for r in made + more], schema).write.parquet(f"{sf}/documents.parquet")
    first, second = corpus_pipeline.run(spark, sf), corpus_pipeline.run(spark, sf)
    kept = sorted((r.doc_id is not None, r.doc_id or 0, r.piece) for r in first.collect())
    assert kept == sorted((r.doc_id is not None, r.doc_id or 0, r.piece) for r in second.collect())
    assert (False, 0, 0) in kept and [k[1] for k in kept].count(10**6) == 0


def test_empty_table(spark):
    docs = chunks.table(spark, "/root/testdata/sf0.001", "documents").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        out = spark.createDataFrame(stage(spark, docs, "").collect(), docs.schema) if stage is not corpus_pipeline.packing_stage else stage(spark, docs, "")
        assert out.count() == 0


def test_words_of_the_packing_do_not_stay_in_a_worker():
    packing.word_encoder.cache_clear()
    batch = pa.RecordBatch.from_pydict({"doc_id": [1], "text": ["some words"]})
    made = []

    class Docs:
        def selectExpr(self, *_):
            return self

        def mapInArrow(self, run, _):
            made.extend(run(iter([batch])))

    packing.cut_pieces(Docs())
    assert made[0].num_rows == 1 and packing.word_encoder.cache_info().currsize == 1
    chunks.trim()
    assert packing.word_encoder.cache_info().currsize == 0
