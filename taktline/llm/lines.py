"""Line dedup that can be taken back: sharded cuckoo filters in front of exact reference counts.

A line's key is the line without white space at its ends, A-Z lower-cased. ``LineIndex`` holds three things, all
written to the shared folder: the rows in chunks; per chunk and shard a reference block (key, number of documents of the
chunk that have it, largest doc_id); per shard a table of exact reference counts with a cuckoo filter of the keys that
reached ``min_docs`` documents. ``insert`` adds chunks and counts. ``delete`` rewrites the chunks that hold the deleted
documents, subtracts their old references and adds the new ones; keys that fall below ``min_docs`` leave the filter.
``cleaned`` asks the filter for each key of each chunk and the exact table for those it lets pass.

Defined cases: a null or empty text is one empty line; a null doc_id is below all others; equal rows count as documents
of their own, and those with the largest doc_id keep the line, all of them; an empty table gives no rows. Columns of the
input that are not used are kept by ``cleaned`` and don't clash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from itertools import compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from taktline.llm import chunks as C
from taktline.llm.cuckoo import CuckooFilter
from taktline.llm.quality import with_text
from taktline.workspace import Workspace

MIN_DOCS = 5
MIN_CHARS = 40
KEY_BYTES = 0.25  # bytes of references per byte of text, about
LOWEST = -(2**63)
STATE = "shard int, counts binary, filter binary"


def line_key(line: bytes, min_chars: int) -> bytes | None:
    """The key, or None if it is too short to count."""
    key = line.strip().lower()
    return key if len(key) >= min_chars and (len(key) >= 4 * min_chars or len(key.decode()) >= min_chars) else None


def _ids(rows: pa.Table) -> list[int]:
    return rows.column("doc_id").cast(pa.int64()).fill_null(LOWEST).to_pylist()


def references(rows: pa.Table, min_chars: int) -> tuple[np.ndarray, ...]:
    """Keys of a chunk (128 bits in two arrays), documents with each, largest doc_id."""
    found: dict[bytes, list[int]] = {}
    for doc, text in zip(_ids(rows), C.texts_of(rows)):
        for key in {k for line in text.split(b"\n") if (k := line_key(line, min_chars)) is not None}:
            digest = xxhash.xxh3_128_digest(key)
            if (have := found.get(digest)) is None:
                found[digest] = [1, doc]
            else:
                have[0] += 1
                have[1] = max(have[1], doc)
    both = np.frombuffer(b"".join(found), ">u8").reshape(-1, 2).astype(np.uint64)
    n, top = (np.fromiter((v[i] for v in found.values()), np.int64, len(found)) for i in (0, 1))
    order = np.lexsort((both[:, 1], both[:, 0]))
    return both[order, 0], both[order, 1], n[order], top[order]


def _merge(high: np.ndarray, low: np.ndarray, n: np.ndarray, top: np.ndarray) -> tuple[np.ndarray, ...]:
    """One entry per key: counts added up, largest doc_id."""
    order = np.lexsort((low, high))
    high, low, n, top = high[order], low[order], n[order], top[order]
    if not len(high):
        return high, low, n, top
    starts = np.flatnonzero(np.append(True, (np.diff(high) != 0) | (np.diff(low) != 0)))
    return high[starts], low[starts], np.add.reduceat(n, starts), np.maximum.reduceat(top, starts)


def _find(high: np.ndarray, low: np.ndarray, in_high: np.ndarray, in_low: np.ndarray) -> np.ndarray:
    """Index of each key in sorted keys, -1 if absent."""
    kind = np.dtype([("h", np.uint64), ("l", np.uint64)])
    where, which = (np.rec.fromarrays(x, dtype=kind) for x in ((in_high, in_low), (high, low)))
    at = np.searchsorted(where, which)
    at[at == len(where)] = 0
    return np.where(where[at] == which, at, -1) if len(where) else np.full(len(which), -1)


class LineIndex:
    """Chunks, references and counts; every change gives a new index and leaves the old tables alone."""

    def __init__(self, store: Workspace, chunks: DataFrame, asked: DataFrame, state: DataFrame, shards: int, min_docs: int, min_chars: int):
        self.store, self.chunks, self.asked, self.state, self.shards = store, chunks, asked, state, shards
        self.min_docs, self.min_chars = min_docs, min_chars

    @classmethod
    def create(cls, docs: DataFrame, store: Workspace, min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS) -> LineIndex:
        chunks = C.make_chunks(docs, store)
        shards = C.shards_for(chunks, KEY_BYTES)
        nothing = docs.sparkSession.createDataFrame([], STATE)
        index = cls(store, chunks, None, nothing, shards, min_docs, min_chars)
        index.asked = index._ask(chunks)
        return index._counted(index.asked.withColumn("sign", F.lit(1)))

    def _ask(self, chunks: DataFrame) -> DataFrame:
        min_chars = self.min_chars
        return self.store.keep(C.ask(chunks, lambda rows: references(rows, min_chars), self.shards), "line-references")

    def _counted(self, change: DataFrame) -> LineIndex:
        """The index after signed references: counts are exact, the filter follows them."""
        min_docs = self.min_docs
        # A removed reference may have been the largest doc_id of its key: the live references tell the next one.
        taken = change.filter("sign < 0").select("shard").distinct()
        live = self.asked.join(taken, "shard", "left_semi").withColumn("sign", F.lit(0))
        both = change.unionByName(live)

        def run(key, left: pa.Table, right: pa.Table) -> pa.Table:
            shard = key[0].as_py()
            before, old = [np.empty(0, np.uint64)] * 2 + [np.empty(0, np.int64)] * 2, None
            for counts, bits in zip(left.column("counts"), left.column("filter")):
                before = C.unpack_keys(counts.as_buffer())
                old = CuckooFilter(C.unpack(bits.as_buffer())[0].reshape(-1, 4))
            parts = [before]
            live_parts = []
            for sign, block in zip(right.column("sign").to_pylist(), right.column("block")):
                high, low, n, top = C.unpack_keys(block.as_buffer())
                if sign:
                    parts.append([high, low, sign * n, top if sign > 0 else np.full(len(top), LOWEST)])
                else:
                    live_parts.append([high, low, n, top])
            high, low, n, top = _merge(*(np.concatenate(x) for x in zip(*parts)))
            if live_parts:
                live_high, live_low, _, live_top = _merge(*(np.concatenate(x) for x in zip(*live_parts)))
                at = _find(high, low, live_high, live_low)
                top = np.where(at >= 0, live_top[at], top)
            there = n > 0
            high, low, n, top = high[there], low[there], n[there], top[there]
            shared = n >= min_docs
            if old is None:
                bits = CuckooFilter.build(high[shared])
            else:
                was = before[2] >= min_docs
                now = _find(before[0], before[1], high[shared], low[shared]) >= 0
                old.delete(before[0][was & ~now])
                had = _find(high, low, before[0][was], before[1][was]) >= 0
                bits = old if old.insert(high[shared & ~had]) else CuckooFilter.build(high[shared])
            return pa.table({"shard": pa.array([shard], pa.int32()), "counts": pa.array([C.pack_keys(high, low, n, top)], pa.binary()),
                             "filter": pa.array([C.pack(bits.buckets.reshape(-1))], pa.binary())})

        state = self.state.groupBy("shard").cogroup(both.groupBy("shard")).applyInArrow(run, STATE)
        return LineIndex(self.store, self.chunks, self.asked, self.store.keep(state, "line-counts"), self.shards, self.min_docs, self.min_chars)

    def insert(self, docs: DataFrame) -> LineIndex:
        """With more documents."""
        chunks = C.make_chunks(docs, self.store)
        last = self.chunks.agg(F.max("chunk")).first()[0]
        chunks = chunks.withColumn("chunk", F.col("chunk") + F.lit((last or 0) + 1))
        asked = self._ask(chunks)
        out = LineIndex(self.store, self.chunks.unionByName(chunks), self.asked.unionByName(asked), self.state, self.shards, self.min_docs, self.min_chars)
        return out._counted(asked.withColumn("sign", F.lit(1)))

    def delete(self, doc_ids: DataFrame) -> LineIndex:
        """Without the documents whose ids are in the column ``doc_id``."""
        held = self.chunks.mapInArrow(_chunk_ids, "chunk long, doc_id long")
        gone = held.join(doc_ids.select(F.col("doc_id").cast("long").alias("doc_id")).distinct(), "doc_id").groupBy("chunk").agg(F.collect_set("doc_id").alias("gone"))

        def drop(batches):
            for batch in batches:
                kept = []
                for row in batch.select(["chunk", "gone", "body"]).to_pylist():
                    rows = C.rows_of(row["body"])
                    out = pc.is_in(rows.column("doc_id").cast(pa.int64()), pa.array(row["gone"], pa.int64()))
                    rows = rows.filter(pc.invert(out.fill_null(False)))
                    kept.append({"chunk": row["chunk"], "n_bytes": sum(map(len, C.texts_of(rows))), "n_rows": rows.num_rows, "body": C._freeze([rows.combine_chunks()])})
                yield pa.RecordBatch.from_pylist(kept, pa.schema([("chunk", pa.int64()), ("n_bytes", pa.int64()), ("n_rows", pa.int64()), ("body", pa.binary())]))

        changed = self.store.keep(self.chunks.join(gone, "chunk").mapInArrow(drop, C.CHUNK_SCHEMA), "chunks-after-delete")
        names = changed.select("chunk")
        old = self.asked.join(names, "chunk", "left_semi")
        new = self._ask(changed)
        out = LineIndex(
            self.store, self.chunks.join(names, "chunk", "left_anti").unionByName(changed), self.asked.join(names, "chunk", "left_anti").unionByName(new),
            self.state, self.shards, self.min_docs, self.min_chars)
        return out._counted(old.withColumn("sign", F.lit(-1)).unionByName(new.withColumn("sign", F.lit(1))))

    def verdicts(self) -> DataFrame:
        """Per chunk and shard: keys to drop and the doc_id that keeps each."""
        min_docs = self.min_docs

        def run(key, left: pa.Table, right: pa.Table) -> pa.Table:
            out = []
            if left.num_rows:
                high, low, n, top = C.unpack_keys(left.column("counts")[0].as_buffer())
                shared = n >= min_docs
                high, low, top = high[shared], low[shared], top[shared]
                bits = CuckooFilter(C.unpack(left.column("filter")[0].as_buffer())[0].reshape(-1, 4))
                for chunk, block in zip(right.column("chunk").to_pylist(), right.column("block")):
                    own_high, own_low, *_ = C.unpack_keys(block.as_buffer())
                    maybe = bits.contains(own_high)
                    own_high, own_low = own_high[maybe], own_low[maybe]
                    at = _find(own_high, own_low, high, low)
                    yes = at >= 0
                    if yes.any():
                        out.append(C.blocks(chunk, [(key[0].as_py(), C.pack_keys(own_high[yes], own_low[yes], top[at[yes]]))]))
            return pa.Table.from_batches(out, schema=C.blocks(0, []).schema)

        return self.state.groupBy("shard").cogroup(self.asked.groupBy("shard")).applyInArrow(run, C.BLOCK_SCHEMA)

    def visit(self, use: Callable[[pa.Table, list[list[bool]]], pa.Table], schema) -> DataFrame:
        """``use(rows, for each row which lines stay)`` for every chunk."""
        min_chars = self.min_chars

        def run(rows: pa.Table, found) -> pa.Table:
            drop = {}
            if found is not None:
                keys = np.stack([found[0], found[1]], 1).astype(">u8").tobytes()
                drop = {keys[16 * i : 16 * i + 16]: top for i, top in enumerate(found[2].tolist())}
            stay = []
            for doc, text in zip(_ids(rows), C.texts_of(rows)):
                lines = text.split(b"\n")
                if not drop:
                    stay.append([True] * len(lines))
                    continue
                stay.append([(k := line_key(x, min_chars)) is None or drop.get(xxhash.xxh3_128_digest(k), doc) == doc for x in lines])
            return use(rows, stay)

        return C.meet(self.chunks, self.verdicts(), run, schema)

    def cleaned(self, schema: T.StructType) -> DataFrame:
        """The rows as they came, texts without the dropped lines. ``schema``: of the rows."""
        return self.visit(lambda rows, stay: with_text(rows, [_kept(t, s) for t, s in zip(C.texts_of(rows), stay)]), schema)

    def report(self) -> DataFrame:
        """Counts and a digest of the kept text per row."""

        def use(rows: pa.Table, stay: list[list[bool]]) -> pa.Table:
            digests = [hashlib.sha256(_kept(t, s)).hexdigest() for t, s in zip(C.texts_of(rows), stay)]
            return pa.table({"doc_id": rows.column("doc_id").cast(pa.int64()), "n_lines": pa.array(list(map(len, stay)), pa.int64()),
                             "n_dropped": pa.array([len(s) - sum(s) for s in stay], pa.int64()), "kept_sha256": pa.array(digests, pa.string())})

        return self.visit(use, "doc_id long, n_lines long, n_dropped long, kept_sha256 string")


def _kept(text: bytes, stay: list[bool]) -> bytes:
    return text if all(stay) else b"\n".join(compress(text.split(b"\n"), stay))


def _chunk_ids(batches):
    for batch in batches:
        for chunk, body in zip(batch.column("chunk").to_pylist(), batch.column("body")):
            ids = C.rows_of(body.as_buffer()).column("doc_id").cast(pa.int64()).combine_chunks()
            yield pa.RecordBatch.from_arrays([pa.array([chunk] * len(ids), pa.int64()), ids], names=["chunk", "doc_id"])


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of all documents that five documents share stay in the last of them only."""
    docs = C.table(spark, sf_dir, "documents").select("doc_id", "text")
    return LineIndex.create(docs, Workspace(spark)).report()


SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT r, doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS i FROM d),
k AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
shared AS (
  SELECT key, max(doc_id) AS top FROM k WHERE length(key) >= {MIN_CHARS} GROUP BY key
  HAVING count(DISTINCT r) >= {MIN_DOCS})
SELECT doc_id, count(*)::BIGINT AS n_lines, count_if(gone)::BIGINT AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM (SELECT k.*, s.key IS NOT NULL AND k.doc_id <> s.top AS gone FROM k LEFT JOIN shared s ON k.key = s.key)
GROUP BY r, doc_id
"""

QUERIES = {"op3_line_dedup": op3_line_dedup}
ORACLES = {"op3_line_dedup": SQL}
