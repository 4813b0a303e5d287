"""From documents to training sequences: quality rules, line dedup, near copies, repeated passages, packing.

Every stage takes the rows that the one before it left, and all but the last return the columns of ``documents``. A
stage's text is the next one's: removed lines and passages are gone, and ``n_chars`` is counted anew. The stages keep the
defined results of their operators for nulls, empty texts, equal rows and empty tables. Near copies are documents that
share 80 percent of their runs of five words; the one with the least doc_id stays.
"""

from __future__ import annotations

from collections.abc import Callable
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

from taktline.llm import chunks, jaccard, lines, packing, quality, repeats
from taktline.workspace import Workspace

SHINGLE_WORDS = 5
SIMILAR_PERCENT = 80

_direct: list[Workspace] = []  # of stages that are called one by one
_stores: ContextVar[list[Workspace] | None] = ContextVar("stores of the stage that runs now", default=None)


def _store(spark: SparkSession, docs: DataFrame) -> Workspace:
    """A workspace for one stage.

    ``run`` removes the workspaces of its own stages. Where stages are called one by one, their results are to be written
    before the next one begins (that is what a stage is given); then those that ``docs`` doesn't read from are removed.
    """
    chunks.prepare(spark)
    own = _stores.get()
    if own is None:
        read = docs.inputFiles()
        for old in list(_direct):
            if not any(old.folder.split("/")[-1] in file for file in read):
                _direct.remove(old)
                if old.spark is spark:
                    old.close()
        own = _direct
    chunks.release(spark)
    own.append(Workspace(spark))
    return own[-1]


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules keep, without the lines that fail."""
    chunks.prepare(spark)
    return quality.keep_good(docs)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that five documents share stay in the last of them."""
    return lines.LineIndex.create(docs, _store(spark, docs)).cleaned(docs.schema)


def near_copy_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return jaccard.one_of_each(docs, _store(spark, docs), SHINGLE_WORDS, SIMILAR_PERCENT)


def repeat_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 bytes that a smaller doc_id has are cut out."""
    return repeats.without_repeats(docs, _store(spark, docs))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of what is left, packed in sequences."""
    return packing.pack_documents(docs, _store(spark, docs))


STAGES = [
    ("quality rules", quality_stage),
    ("line dedup", line_stage),
    ("n-gram jaccard join", near_copy_stage),
    ("suffix-array dedup", repeat_stage),
    ("best-fit packing", packing_stage),
]

#: SQL has no tokenizer and no genetic algorithm; tests compare every stage with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over all documents; each result is written and read again.

    Intermediate tables go when the result that was made from them is written. The rows returned read the last written
    result and the tables of the last stage; these stay, whatever runs later.
    """
    docs, before = chunks.table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        kept = Workspace(spark)
        result, used = _with_stores(lambda: kept.keep(stage(spark, docs, sf_dir), name.replace(" ", "-")))
        for old in [*used, *([before] if before else [])]:
            old.close()
        docs, before = result, kept
    return _with_stores(lambda: STAGES[-1][1](spark, docs, sf_dir))[0]


def _with_stores(step: Callable[[], DataFrame]) -> tuple[DataFrame, list[Workspace]]:
    """Result of a step, and the workspaces that its stage took."""
    used: list[Workspace] = []
    token = _stores.set(used)
    try:
        return step(), used
    finally:
        _stores.reset(token)
