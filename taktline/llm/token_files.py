"""Token ids in binary shard files, with a minimal perfect hash index for access by document key.

Documents are sorted by doc_id over range partitions and encoded. A shard file holds, little-endian: ``HEAD`` (magic,
shard, bytes per id, documents, ids), doc_ids (int64) and their null marks (uint8), the first id of each document and the
end (uint64), then the raw ids (uint16 where the vocabulary allows, else uint32). Shards are closed at ``SHARD_IDS`` ids;
one longer document is a shard by itself. Files are written with Spark's text writer, one shard per file, so that they
are committed to any store; the separator that the writer puts behind a row is the end mark of the file. Shard numbers
ascend with the order of the documents.

The index maps a doc_id to shard and place. Rows with one doc_id are neighbours: in each shard they are one run, and
(doc_id, number of the run) is the key, so that a doc_id with a third of all rows is one entry per shard. Keys are hashed
to buckets of about ``BUCKET_KEYS``. A bucket has a minimal perfect hash (three bits a key), and in the slot of each key a
32-bit fingerprint, shard, row, offset, rows of the run and runs of the doc_id. A look-up hashes once per level, compares the
fingerprint, and gives the place; keys that were never stored are refused by the fingerprint, and finally by the doc_id
that stands in the shard.

Defined cases: null text is empty; an empty document is the end id alone; null doc_ids come first and can be looked up;
rows with one doc_id are stored one after the other in an order fixed by their texts, and a look-up gives all of them;
an empty table gives no files to read and no rows; other columns don't matter. A document is one task's work, as its ids
are one sequence; texts are cut at blanks, so that its memory is a few times its size.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from taktline.llm import chunks as C
from taktline.llm.perfect_hash import PerfectHash, fingerprints, key_hashes
from taktline.workspace import Workspace

END_ID = 0
SHARD_IDS = 4 << 20
BUCKET_KEYS = 1 << 12
CACHED = 600_000  # units of one generation kept with their ids in one Python worker; there are two
TOGETHER = 20_000  # new units in one text for the tokenizer
BATCH_CHARS = 8 << 20  # of texts that are encoded together
MAGIC = b"TOKENID1"
HEAD = struct.Struct("<8sqqqq")
END_MARK = "\n.tokens\n"
RUNS = "doc_id long, shard long, row long, offset long, n_rows long, n_ids long"
PLACES = "doc_id long, shard long, row long, offset long, n_rows long, n_runs long"
INDEX = "bucket long, buckets long, levels binary, slots binary"
DOCUMENTS = "shard long, row long, run_row long, doc_id long, offset long, n_tokens long"

# A blank before a character that is no white space always begins a pre-token of the tokenizer file.
_UNIT = re.compile(r"(?<!^)(?= [^\s\x1c-\x1f\x85])")
_WIDE = re.compile(r" (?:[\s\x1c-\x1f\x85]|\Z)")
UNITS = pa.large_list(pa.large_string())
_FIRST = "\x00"  # in front of what stands before the first unit of a text


class UnitEncoder:
    """Packed ids of texts by a byte-level tokenizer.

    A text falls apart in units: a blank and what follows up to the next word. Pre-tokens never cross units, so that the
    ids of a text are those of its units, which are remembered. New units of many texts go to the tokenizer as one text,
    and the bytes behind each id tell where one unit ends.
    """

    def __init__(self, path: str, kind: str):
        from tokenizers import Tokenizer

        self.tokenizer, self.kind = Tokenizer.from_file(path), kind
        self.tokenizer.encode_special_tokens = True
        vocabulary = self.tokenizer.get_vocab()
        self.bytes_of = np.zeros(max(vocabulary.values()) + 1, np.int64)
        self.bytes_of[list(vocabulary.values())] = [len(t) for t in vocabulary]  # one character per byte
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def _ids(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, self.kind) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, new: list[str]) -> None:
        firsts, rest = [u for u in new if u.startswith(_FIRST)], [u for u in new if not u.startswith(_FIRST)]
        self.known.update((u, ids.tobytes()) for u, ids in zip(firsts, self._ids([u[1:] for u in firsts])))
        for start in range(0, len(rest), TOGETHER):
            some = rest[start : start + TOGETHER]
            (ids,) = self._ids([" " + " ".join(some)])
            ends, wanted = np.cumsum(self.bytes_of[ids]), np.cumsum([len(u.encode()) + 1 for u in some])
            at = np.searchsorted(ends, wanted)
            if at[-1] != len(ids) - 1 or (ends[at] != wanted).any():
                raise ValueError("units and their ids don't match")
            packed, cuts = ids.tobytes(), (np.append(0, at + 1) * ids.itemsize).tolist()
            self.known.update((u, packed[a:b]) for u, a, b in zip(some, cuts, cuts[1:]))

    def _packed(self, units: list[str]) -> list[bytes]:
        """Ids of distinct units."""
        out = list(map(self.known.get, units))
        if missing := [i for i, ids in enumerate(out) if ids is None]:
            older = {u: ids for u in map(units.__getitem__, missing) if (ids := self.older.get(u)) is not None}
            self.known.update(older)
            if new := [u for u in map(units.__getitem__, missing) if u not in older]:
                self._learn(new)
            for i in missing:
                out[i] = self.known[units[i]]
        if len(self.known) > CACHED:
            self.known, self.older = {}, self.known
        return out

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """Units are named by a dictionary array, so that Python sees each of them once per call."""
        wide = [bool(_WIDE.search(text)) for text in texts]
        plain = pa.array([_FIRST + text for text, w in zip(texts, wide) if not w], pa.large_string())
        split = [[u[i > 0 :] for i, u in enumerate(_UNIT.split(_FIRST + text))] for text, w in zip(texts, wide) if w]
        lists = pa.concat_arrays([pc.split_pattern(plain, " ").cast(UNITS), pa.array(split, UNITS)])
        named = lists.values.dictionary_encode()
        packed = pa.array(self._packed(named.dictionary.to_numpy(zero_copy_only=False).tolist()), pa.large_binary()).take(named.indices)
        data, ends = memoryview(packed.buffers()[2] or b""), np.frombuffer(packed.buffers()[1], np.int64, len(packed) + 1, 8 * packed.offset)
        cuts = ends[lists.offsets.to_numpy()].tolist()
        parts = [bytes(data[a:b]) for a, b in zip(cuts, cuts[1:])]
        narrow, broad = iter(parts), iter(parts[len(plain) :])
        return [next(broad if w else narrow) for w in wide]


@lru_cache(maxsize=1)
def encoder_of(path: str, kind: str) -> UnitEncoder:
    """One for all tasks of a Python worker, so that units stay known."""
    return UnitEncoder(path, kind)


def id_kind(tokenizer: str) -> str:
    """Bytes of an id: two where all ids fit."""
    from tokenizers import Tokenizer

    return "<u2" if Tokenizer.from_file(tokenizer).get_vocab_size() <= 1 << 16 else "<u4"


def encoded(batches: Iterator[pa.RecordBatch], encoder: UnitEncoder) -> Iterator[tuple[int | None, bytes]]:
    """doc_id and packed ids, some ``BATCH_CHARS`` of text or one document at a time."""
    for batch in batches:
        keys, texts, size = [], [], 0
        for key, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
            keys.append(key)
            texts.append(text.as_py() or "")
            size += len(texts[-1])
            if size > BATCH_CHARS:
                yield from zip(keys, encoder.encode_all(texts))
                keys, texts, size = [], [], 0
        C.trim()
        yield from zip(keys, encoder.encode_all(texts))


def _shard_file(shard: int, kind: str, keys: list[int | None], parts: list[bytes]) -> bytes:
    width = np.dtype(kind).itemsize
    ends = np.cumsum([0, *map(len, parts)], dtype=np.uint64) // np.uint64(width)
    return b"".join([
        HEAD.pack(MAGIC, shard, width, len(keys), int(ends[-1])), np.array([k or 0 for k in keys], "<i8").tobytes(),
        np.array([k is None for k in keys], np.uint8).tobytes(), ends.astype("<u8").tobytes(), *parts])


class Shard:
    """A shard file that was read; arrays are views of its bytes."""

    def __init__(self, data):
        magic, self.shard, width, n, ids = HEAD.unpack_from(data)
        at = HEAD.size
        size = at + 9 * n + 8 * (n + 1) + width * ids
        if magic != MAGIC or bytes(data[size:]) != END_MARK.encode():
            raise ValueError("no whole shard of token ids")
        self.keys = np.frombuffer(data, "<i8", n, at)
        self.absent = np.frombuffer(data, np.uint8, n, at + 8 * n).astype(bool)
        self.starts = np.frombuffer(data, "<u8", n + 1, at + 9 * n).astype(np.int64)
        self.ids = np.frombuffer(data, f"<u{width}", ids, at + 9 * n + 8 * (n + 1))

    def runs(self) -> np.ndarray:
        """First rows of the runs of one doc_id."""
        new = np.ones(len(self.keys), bool)
        new[1:] = (self.keys[1:] != self.keys[:-1]) | (self.absent[1:] != self.absent[:-1])
        return np.flatnonzero(new)


class TokenFiles:
    """A folder of shard files and their index."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = C.prepare(spark), folder.rstrip("/")

    def write(self, docs: DataFrame, tokenizer: str, end_id: int = END_ID, shard_ids: int = SHARD_IDS) -> "TokenFiles":
        """Files of all documents (doc_id, text), and the index."""
        kind = id_kind(tokenizer)

        def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            encoder, end = encoder_of(tokenizer, kind), np.array([end_id], kind).tobytes()
            keys, parts, size, shard = [], [], 0, TaskContext.get().partitionId() << 32
            limit = shard_ids * len(end)

            def close() -> pa.RecordBatch:
                data = pa.array([_shard_file(shard, kind, keys, parts)], pa.binary())
                return pa.RecordBatch.from_arrays([data], names=["value"])

            for key, part in encoded(batches, encoder):
                part += end
                if keys and size + len(part) > limit:
                    yield close()
                    keys, parts, size, shard = [], [], 0, shard + 1
                keys.append(key)
                parts.append(part)
                size += len(part)
            if keys:
                yield close()

        # Rows of one doc_id spread over ranges; equal rows are told apart by their place in the input.
        ordered = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text"), F.col("_place")]
        rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("_place", F.monotonically_increasing_id())
        rows = rows.repartitionByRange(*ordered).sortWithinPartitions(*ordered)
        (rows.select("doc_id", "text").mapInArrow(encode, "value binary").select(F.col("value").cast("string").alias("value"))
         .write.option("lineSep", END_MARK).option("maxRecordsPerFile", 1).text(f"{self.folder}/ids"))
        self.build_index()
        return self

    def _map(self, each, schema: str) -> DataFrame:
        """``each(Shard)`` gives the columns of one shard."""
        names = [f.split()[0] for f in schema.split(", ")]
        kinds = C.arrow_schema(schema)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for content in batch.column("content"):
                    if len(data := memoryview(content.as_buffer())):
                        columns = each(Shard(data))
                        yield pa.RecordBatch.from_arrays([pa.array(columns[n], kinds.field(n).type) for n in names], schema=kinds)

        return self.spark.read.format("binaryFile").load(f"{self.folder}/ids").select("content").mapInArrow(run, schema)

    def documents(self, ids: bool = False) -> DataFrame:
        """One row per document, as read from the files: place, size, crc32 of its ids as uint32, the ids if asked."""

        def each(s: Shard) -> dict:
            n, runs = len(s.keys), s.runs()
            wide = s.ids.astype("<u4")
            bounds = list(zip(s.starts.tolist(), s.starts[1:].tolist()))
            out = {
                "shard": np.full(n, s.shard), "row": np.arange(n), "run_row": np.repeat(runs, np.diff(np.append(runs, n))),
                "doc_id": pa.array(s.keys, mask=s.absent), "offset": s.starts[:-1], "n_tokens": np.diff(s.starts),
                "ids_crc32": [zlib.crc32(wide[a:b]) for a, b in bounds]}
            return out | ({"ids": [wide[a:b] for a, b in bounds]} if ids else {})

        return self._map(each, DOCUMENTS + ", ids_crc32 long" + (", ids array<long>" if ids else ""))

    def build_index(self) -> None:
        def runs(s: Shard) -> dict:
            first = s.runs()
            last = np.append(first[1:], len(s.keys))
            return {
                "doc_id": pa.array(s.keys[first], mask=s.absent[first]), "shard": np.full(len(first), s.shard), "row": first,
                "offset": s.starts[first], "n_rows": last - first, "n_ids": s.starts[last] - s.starts[first]}

        self._map(runs, RUNS).write.parquet(f"{self.folder}/runs")
        found = self.spark.read.schema(RUNS).parquet(f"{self.folder}/runs")
        buckets = max(1, found.count() // BUCKET_KEYS)
        of_key = Window.partitionBy("doc_id")  # one row per shard that holds the doc_id
        found = found.withColumns({"part": F.row_number().over(of_key.orderBy("shard", "row")) - 1, "n_runs": F.count(F.lit(1)).over(of_key)})

        def build(group: pa.Table) -> pa.Table:
            columns = {n: group.column(n).to_numpy() for n in ("shard", "row", "offset", "n_rows", "n_runs", "part")}
            first, second = key_hashes(*_keys(group.column("doc_id"), columns["part"]))
            hashed = PerfectHash.build(first, second)
            order = np.argsort(hashed.index(first, second))
            slots = [fingerprints(first, second), *(columns[n] for n in ("shard", "row", "offset", "n_rows", "n_runs"))]
            return pa.table({
                "bucket": group.column("bucket")[:1], "buckets": [buckets], "levels": [C.pack(hashed.sizes, hashed.words)],
                "slots": [C.pack(*(x[order] for x in slots))]}, schema=C.arrow_schema(INDEX))

        found.withColumn("bucket", _bucket(buckets)).groupBy("bucket").applyInArrow(build, INDEX).write.parquet(f"{self.folder}/index")

    def starts(self) -> DataFrame:
        """Number of all ids before each shard, from sums per written partition and sums inside it."""
        shards = self.spark.read.schema(RUNS).parquet(f"{self.folder}/runs").groupBy("shard").agg(F.sum("n_ids").alias("n_ids"))
        return _running_sum(shards)

    def lookup(self, keys: DataFrame) -> DataFrame:
        """Places of the runs of each doc_id of ``keys`` that is stored."""
        index = self.spark.read.schema(INDEX).parquet(f"{self.folder}/index")
        named = index.select("buckets").limit(1).collect()
        buckets = named[0][0] if named else 1
        wanted = keys.select(F.col("doc_id").cast("long").alias("doc_id")).distinct().withColumn("part", F.lit(0).cast("long"))
        heads = self._probe(index, wanted, buckets)
        more = heads.filter("n_runs > 1").select("doc_id", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n_runs") - 1)).alias("part"))
        return heads.unionByName(self._probe(index, more, buckets))

    def _probe(self, index: DataFrame, wanted: DataFrame, buckets: int) -> DataFrame:
        kinds = C.arrow_schema(PLACES)

        def probe(left: pa.Table, right: pa.Table) -> pa.Table:
            if not left.num_rows or not right.num_rows:
                return kinds.empty_table()
            hashed = PerfectHash(*C.unpack(right.column("levels")[0].as_buffer()))
            mark, *slots = C.unpack(right.column("slots")[0].as_buffer())
            first, second = key_hashes(*_keys(left.column("doc_id"), left.column("part").to_numpy()))
            at = hashed.index(first, second)
            hit = (at >= 0) & (mark[at] == fingerprints(first, second))
            return pa.table([left.column("doc_id").filter(pa.array(hit)), *(pa.array(s[at[hit]]) for s in slots)], schema=kinds)

        return (wanted.withColumn("bucket", _bucket(buckets)).groupBy("bucket")
                .cogroup(index.groupBy("bucket")).applyInArrow(probe, PLACES))

    def fetch(self, keys: DataFrame, ids: bool = True) -> DataFrame:
        """The documents of the given doc_ids, by way of the index, with the number of all ids before each."""
        places = self.lookup(keys).select(F.col("doc_id").alias("_key"), "shard", F.col("row").alias("run_row"))
        found = self.documents(ids).join(places, ["shard", "run_row"]).filter(F.col("doc_id").eqNullSafe(F.col("_key")))
        found = found.join(self.starts(), "shard").withColumn("start", F.col("before") + F.col("offset"))
        return found.select("doc_id", "start", "n_tokens", "ids_crc32", *(["ids"] if ids else []))


def _keys(column: pa.ChunkedArray, part: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return column.fill_null(0).to_numpy(), part, column.is_null().to_numpy()


def _bucket(buckets: int) -> Column:
    return F.pmod(F.xxhash64("doc_id", F.col("part").cast("long")), F.lit(buckets))


def _running_sum(shards: DataFrame) -> DataFrame:
    """Ids before each shard: parts are the partitions that wrote the shards."""
    parted = shards.withColumn("_part", F.shiftright("shard", 32))
    earlier = lambda w: F.coalesce(F.sum("n_ids").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = parted.groupBy("_part").agg(F.sum("n_ids").alias("n_ids"))  # one row per partition of the writing job
    before = parts.select("_part", earlier(Window.orderBy("_part")).alias("_parts"))
    inside = parted.withColumn("_inside", earlier(Window.partitionBy("_part").orderBy("shard")))
    return inside.join(before, "_part").select("shard", (F.col("_parts") + F.col("_inside")).alias("before"))


def op12_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents through files of token ids, read back by key."""
    import public_tokenizers

    docs = C.table(spark, sf_dir, "documents")
    files = TokenFiles(spark, f"{Workspace(spark).folder}/tokens").write(docs, public_tokenizers.path("byte_bpe_50k.json"))
    return files.fetch(docs, ids=False)


QUERIES = {"op12_token_files": op12_token_files}
ORACLES: dict[str, str] = {}
