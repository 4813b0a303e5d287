"""Byte-level BPE: overlapping chunks, stitched where pre-token boundaries meet again, then encoded piece by piece.

A text is cut into chunks of ``CHUNK_CHARS`` code points, each with ``OVERLAP`` more behind it. Every chunk is
pre-tokenised from its own start, on its own. In the overlap both neighbours know boundaries; from the first one they
share they agree for good, since a match depends on what follows only, and so the earlier chunk ends and the later one
starts there. A text with an overlap without a shared boundary (one run longer than the overlap) is pre-tokenised in one
piece, which is exact. The pieces of each chunk are merged by rank; decoding joins the bytes of the ids.

A text of one chunk needs no stitching and never leaves its task. Ids of a longer text meet in order at its digest.

Defined cases: a null or empty text has no tokens; a null doc_id is passed on; equal rows are encoded alike, each on its
own; an empty table gives no rows; other columns don't matter.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator
from functools import lru_cache
from struct import pack

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window
from pyspark.sql import functions as F

from taktline.llm import chunks as C
from taktline.workspace import Workspace

CHUNK_CHARS = 1 << 16
OVERLAP = 1 << 10
UNSURE = 4  # code points at the cut end of a chunk whose boundaries may move with the text behind
CACHED = 200_000  # pieces of one generation kept with their ids in one Python worker; there are two
LONG_PIECE = 48  # bytes from which merges go through a heap
DIGEST = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def merge_short(piece: bytes, ranks: dict[bytes, int]) -> list[bytes]:
    """Merge the neighbours of lowest rank, leftmost first, until none can be merged."""
    parts = [piece[i : i + 1] for i in range(len(piece))]
    rank_of, never = ranks.get, len(ranks) + 1
    pairs = [rank_of(a + b, never) for a, b in zip(parts, parts[1:])]
    while pairs and (best := min(pairs)) < never:
        i = pairs.index(best)
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
        del pairs[i]
        if i:
            pairs[i - 1] = rank_of(parts[i - 1] + parts[i], never)
        if i < len(pairs):
            pairs[i] = rank_of(parts[i] + parts[i + 1], never)
    return parts


def merge_long(piece: bytes, ranks: dict[bytes, int]) -> list[bytes]:
    """The same for long pieces: candidate merges in a heap, parts in a linked list."""
    n = len(piece)
    after = list(range(1, n + 1))
    before = list(range(-1, n - 1))
    ends = list(range(1, n + 1))  # end of the part that starts here, 0 if none does
    heap: list[tuple[int, int, int]] = []

    def offer(i: int) -> None:
        if i >= 0 and (j := after[i]) < n and (rank := ranks.get(piece[i : ends[j]])) is not None:
            heapq.heappush(heap, (rank, i, ends[j]))

    for i in range(n - 1):
        offer(i)
    while heap:
        _, i, end = heapq.heappop(heap)
        if not ends[i] or ends[i] == end or after[i] >= n or ends[after[i]] != end:
            continue  # one of the two parts has changed meanwhile
        j = after[i]
        ends[i], ends[j] = end, 0
        after[i] = after[j]
        if after[j] < n:
            before[after[j]] = i
        offer(i)
        offer(before[i])
    out, i = [], 0
    while i < n:
        out.append(piece[i : ends[i]])
        i = after[i]
    return out


class Encoder(dict):
    """Packed ids of pieces, by the ranks of a vocabulary file."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.bytes_of = {rank: token for token, rank in self.ranks.items()}
        self.pattern = regex.compile(pattern)
        self.older: dict[str, bytes] = {}

    def __missing__(self, piece: str) -> bytes:
        packed = self.older.get(piece)
        if packed is None:
            packed = self.packed(piece.encode())
        if len(piece) < 4 * LONG_PIECE:
            if len(self) >= CACHED:
                self.older = dict(self)
                self.clear()
            self[piece] = packed
        return packed

    def packed(self, raw: bytes) -> bytes:
        whole = self.ranks.get(raw)
        if whole is not None:
            ids = [whole]
        else:
            ids = [self.ranks[p] for p in (merge_short if len(raw) < LONG_PIECE else merge_long)(raw, self.ranks)]
        return pack(f"<{len(ids)}I", *ids)

    def encode_pieces(self, pieces: list[str]) -> bytes:
        """Little-endian 32-bit ids."""
        return b"".join(map(self.__getitem__, pieces))

    def encode(self, text: str) -> bytes:
        return self.encode_pieces(self.pattern.findall(text))

    def decode(self, packed: bytes) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(packed, "<u4").tolist()))


@lru_cache(2)
def encoder(vocabulary: str | None, pattern: str | None) -> Encoder:
    import public_tokenizers

    return Encoder(vocabulary or public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), pattern or public_tokenizers.PATTERN)


def _digest(batches: Iterator[list[tuple[int | None, list[bytes]]]], make: Encoder) -> Iterator[pa.RecordBatch]:
    """Rows of DIGEST from (doc_id, packed ids in parts)."""
    for rows in batches:
        out = []
        for doc, parts in rows:
            ids, decoded, n = hashlib.sha256(), hashlib.sha256(), 0
            for part in parts:
                ids.update(part)
                decoded.update(make.decode(part))
                n += len(part) // 4
            out.append((doc, n, ids.hexdigest(), decoded.hexdigest()))
        columns = list(zip(*out)) or [()] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, C.arrow_schema(DIGEST))], schema=C.arrow_schema(DIGEST))


def encode_digests(docs: DataFrame, store: Workspace, vocabulary: str | None = None, pattern: str | None = None, chunk_chars: int = CHUNK_CHARS, overlap: int = OVERLAP) -> DataFrame:
    """Token counts and digests per row of (doc_id, text)."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = encoder(vocabulary, pattern)
        yield from _digest(([(d, [make.encode(t)]) for d, t in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist())] for b in batches), make)

    short = rows.filter(F.length("text") <= chunk_chars).mapInArrow(whole, DIGEST)
    cut = rows.filter(F.length("text") > chunk_chars).withColumn("row", F.monotonically_increasing_id())
    cut = cut.select("row", "doc_id", F.posexplode(F.expr(f"sequence(0, cast((length(text) - 1) DIV {chunk_chars} AS int))")).alias("no", "_at"), "text", F.expr(f"(length(text) - 1) DIV {chunk_chars}").alias("last"))
    pieces = cut.select("row", "doc_id", "no", (F.col("no") == F.col("last")).alias("is_last"), F.expr(f"substring(text, no * {chunk_chars} + 1, {chunk_chars + overlap})").alias("text"))

    def bounds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = encoder(vocabulary, pattern).pattern.finditer
        for batch in batches:
            heads, tails = [], []
            for text, last in zip(batch.column("text").to_pylist(), batch.column("is_last").to_pylist()):
                ends = [0] + [m.end() for m in find(text)]
                sure = len(text) if last else len(text) - UNSURE
                heads.append([e for e in ends if e <= min(overlap, sure)])
                tails.append([e - chunk_chars for e in ends if chunk_chars <= e <= sure])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(heads, pa.list_(pa.int64())), pa.array(tails, pa.list_(pa.int64()))], names=[*batch.schema.names, "head", "tail"])

    known = store.keep(pieces.mapInArrow(bounds, "row long, doc_id long, no int, is_last boolean, text string, head array<long>, tail array<long>"), "chunks")
    order = Window.partitionBy("row").orderBy("no")
    joint = known.select("row", "no", "is_last", F.array_min(F.array_intersect(F.lag("tail").over(order), "head")).alias("start"), F.array_min(F.array_intersect("tail", F.lead("head").over(order))).alias("end"))
    stitch = joint.withColumn("lost", F.max((~F.col("is_last") & F.col("end").isNull()).cast("int")).over(Window.partitionBy("row"))).drop("is_last")
    stitched = store.keep(known.drop("head", "tail").join(stitch, ["row", "no"]), "stitched")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = encoder(vocabulary, pattern)
        for batch in batches:
            ids = []
            for text, start, end, last in zip(*(batch.column(c).to_pylist() for c in ("text", "start", "end", "is_last"))):
                # From a shared boundary on, matches are those of the whole text.
                stop = len(text) if last else chunk_chars + end
                ids.append(make.encode_pieces([m[0] for m in make.pattern.finditer(text, start or 0) if m.end() <= stop and m.start() < stop]))
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("doc_id"), batch.column("no"), pa.array(ids, pa.binary())], names=["row", "doc_id", "no", "ids"])

    def join_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = encoder(vocabulary, pattern)
        yield from _digest(([(d, [p["ids"] for p in parts]) for d, parts in zip(b.column("doc_id").to_pylist(), b.column("parts").to_pylist())] for b in batches), make)

    parts = stitched.filter("lost = 0").mapInArrow(encode, "row long, doc_id long, no int, ids binary")
    long = parts.groupBy("row", "doc_id").agg(F.array_sort(F.collect_list(F.struct("no", "ids"))).alias("parts")).mapInArrow(join_parts, DIGEST)
    # No shared boundary in some overlap: the whole text from its chunks, in one piece.
    core = stitched.filter("lost = 1").select("row", "doc_id", "no", F.when(F.col("is_last"), F.col("text")).otherwise(F.substring("text", 1, chunk_chars)).alias("text"))
    uncut = core.groupBy("row", "doc_id").agg(F.array_sort(F.collect_list(F.struct("no", "text"))).alias("parts")).select("doc_id", F.array_join("parts.text", "").alias("text"))
    return short.unionByName(long).unionByName(uncut.mapInArrow(whole, DIGEST))


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents encoded and decoded."""
    return encode_digests(C.table(spark, sf_dir, "documents"), Workspace(spark))


QUERIES = {"op5_byte_bpe": op5_byte_bpe}
ORACLES: dict[str, str] = {}
