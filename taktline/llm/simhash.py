"""SimHash fingerprints: weighted term hashes vote on signed bits; permuted block tables find near fingerprints.

Terms of a text are its runs of five words (weight: their number) and its distinct words (half a vote each), A-Z
lower-cased. Each term has 128 hash bits; a bit of the fingerprint is set if the votes for it win. The likeness of two
fingerprints is the cosine that their differing bits stand for, cos(pi * bits / 128), not below 0.

``edited`` compares each text with its own last third replaced by the start of the next one. "Next" is an order over the
whole table: rows are range-partitioned and sorted, every task pairs its own neighbours, and only the first and last row
of each range meet afterwards.

``within_radius`` cuts fingerprints into radius + 2 blocks. Two fingerprints within the radius agree on two blocks, so
that the tables keyed by each pair of blocks find them all.

Defined cases: a null or empty text has no terms and the fingerprint 0; a null doc_id comes after all others; rows with
equal doc_id are ordered by text; a table of one row is its own next; an empty table gives no rows; other columns don't
matter.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from taktline.llm import chunks as C
from taktline.llm.words import SEED, mix, run_hashes, word_hashes
from taktline.workspace import Workspace

BITS = 128
RUN = 5
RADIUS = 3
RESULT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
STREAM = RESULT + ", part int, kind int, text string"  # kind 0: done, 1: last of its range, 2: first of its range


def _sum_of_bits(hashes: np.ndarray) -> np.ndarray:
    wide = np.stack([hashes, mix(hashes ^ SEED)], 1)
    return np.unpackbits(wide.view(np.uint8).reshape(-1, BITS // 8), axis=1).sum(0, dtype=np.int64)


def fingerprint(text: str) -> bytes:
    words = word_hashes(text.encode("utf-8", "surrogatepass").lower().split())
    if not len(words):
        return bytes(BITS // 8)
    runs, single = run_hashes(words, RUN), mix(np.unique(words))
    votes = 2 * (2 * _sum_of_bits(runs) - len(runs)) + 2 * _sum_of_bits(single) - len(single)
    return np.packbits(votes > 0).tobytes()


def differing(a: bytes, b: bytes) -> int:
    return (int.from_bytes(a) ^ int.from_bytes(b)).bit_count()


def likeness(a: bytes, b: bytes) -> float:
    return max(0.0, math.cos(math.pi * differing(a, b) / BITS))


def edited(text: str, after: str) -> str:
    n = len(text) // 3
    return text[: len(text) - n] + after[:n]


def _row(doc, text: str, own: bytes, after: str, after_print: bytes) -> tuple:
    changed = edited(text, after)
    other = fingerprint(changed)
    return doc, len(text), hashlib.sha256(changed.encode()).hexdigest(), own.hex(), other.hex(), likeness(own, other), likeness(own, after_print)


def _batch(rows: list[tuple], ddl: str) -> pa.RecordBatch:
    schema = C.arrow_schema(ddl)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(list(zip(*rows)) or [()] * len(schema), schema)], schema=schema)


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of one sorted range: each with the one behind it."""
    part, held = TaskContext.get().partitionId(), None
    for batch in batches:
        rows = []
        for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
            own = fingerprint(text)
            if held is None:
                rows.append((doc, None, None, own.hex(), None, None, None, part, 2, text))
            else:
                rows.append((*_row(*held, text, own), part, 0, None))
            held = (doc, text, own)
        yield _batch(rows, STREAM)
    if held is not None:
        yield _batch([(held[0], None, None, held[2].hex(), None, None, None, part, 1, held[1])], STREAM)


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield _batch([_row(r["doc_id"], r["text"], bytes.fromhex(r["fingerprint"]), r["_text"], bytes.fromhex(r["_print"])) for r in batch.to_pylist()], RESULT)


def compare_edited(docs: DataFrame, store: Workspace) -> DataFrame:
    """Fingerprints of (doc_id, text) and of the edited texts, in descending order of doc_id."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    order = [F.col("doc_id").desc_nulls_last(), F.xxhash64("text"), F.col("text")]
    ranged = rows.repartitionByRange(*order[:2]).sortWithinPartitions(*order)
    made = store.keep(ranged.mapInArrow(_neighbours, STREAM), "fingerprints")
    # One number per range, to know which range is next.
    parts = sorted(r.part for r in made.filter("kind = 2").select("part").collect())
    after = docs.sparkSession.createDataFrame(list(zip(parts, parts[1:] + parts[:1])), "part int, _next int")
    heads = made.filter("kind = 2").select(F.col("part").alias("_next"), F.col("text").alias("_text"), F.col("fingerprint").alias("_print"))
    tails = made.filter("kind = 1").join(after, "part").join(heads, "_next").select("doc_id", "text", "fingerprint", "_text", "_print")
    columns = [x.strip().split()[0] for x in RESULT.split(",")]
    return made.filter("kind = 0").select(*columns).unionByName(tails.mapInArrow(_ends, RESULT))


def fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprint of each row of (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield _batch([(d, fingerprint(t or "").hex()) for d, t in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist())], "doc_id long, fingerprint string")

    return docs.selectExpr("cast(doc_id AS long) AS doc_id", "cast(text AS string) AS text").mapInArrow(run, "doc_id long, fingerprint string")


def within_radius(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """All pairs (a, b, bits) of different fingerprints, a < b, that differ in at most ``radius`` bits.

    Rows with equal fingerprints are one class: their membership is ``prints`` itself.
    """
    blocks = radius + 2
    edges = [round(i * BITS / blocks) for i in range(blocks + 1)]
    one = prints.select("fingerprint").filter("fingerprint IS NOT NULL").distinct()
    halves = [F.conv(F.substring("fingerprint", 1 + 16 * i, 16), 16, -10).cast("long").alias(f"w{i}") for i in range(2)]
    one = one.select("fingerprint", *halves)

    def block(i: int):
        """Bits of one block as text, of the binary digits."""
        return F.substring("digits", edges[i] + 1, edges[i + 1] - edges[i])

    digits = F.concat(*(F.lpad(F.conv(F.substring("fingerprint", 1 + 8 * i, 8), 16, 2), 32, "0") for i in range(4)))
    keys = F.array(*(F.concat(F.lit(f"{i}-{j}:"), block(i), F.lit(":"), block(j)) for i, j in combinations(range(blocks), 2)))
    tables = one.withColumn("digits", digits).select("fingerprint", "w0", "w1", F.explode(keys).alias("key")).withColumn("key", F.md5("key"))
    left, right = tables.alias("l"), tables.alias("r")
    bits = (F.bit_count(F.col("l.w0").bitwiseXOR(F.col("r.w0"))) + F.bit_count(F.col("l.w1").bitwiseXOR(F.col("r.w1"))))
    met = left.join(right, (F.col("l.key") == F.col("r.key")) & (F.col("l.fingerprint") < F.col("r.fingerprint")) & (bits <= radius))
    return met.select(F.col("l.fingerprint").alias("a"), F.col("r.fingerprint").alias("b"), bits.cast("int").alias("bits")).distinct()


def op8_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents against their edited texts and the next document."""
    return compare_edited(C.table(spark, sf_dir, "documents"), Workspace(spark))


QUERIES = {"op8_document_fingerprints": op8_document_fingerprints}
ORACLES: dict[str, str] = {}
