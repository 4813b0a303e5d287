"""Chunks of rows and a sharded exchange of keys between them.

Operators that compare every n-gram, line or word of a corpus move far more keys than rows. Here rows are kept in
chunks of a bounded number of bytes, written once to the shared folder. Each chunk sends the sorted keys of each shard
as one packed block; each shard (keys of one hash range, a bounded part of all keys) answers every chunk for its own
keys; the answers meet the chunk again. A key that occurs everywhere is one entry per chunk, so that no key makes a
shard large. Blocks are numpy arrays, compressed, and Spark shuffles them.
"""

from __future__ import annotations

import ctypes
import ctypes.util
import gc
import marshal
import sys
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from taktline.session import tune
from taktline.workspace import Workspace

CHUNK_BYTES = 2 << 20  # text of one chunk; a longer row is a chunk by itself
SHARD_BYTES = 12 << 20  # raw keys that one shard sees, about
MAX_ROWS = 1 << 15  # rows of a chunk from which it is closed
BATCH_ROWS = 512  # rows per Arrow batch, for bounded memory with long texts
BATCH_BYTES = 4 << 20  # bytes from which a batch is closed: rows may be chunks and blocks

BODY_LEVEL = 7  # zstd level of chunks, which are written once and shuffled several times

_name = ctypes.util.find_library("c") if sys.platform == "linux" else None
_libc = ctypes.CDLL(_name) if _name and _name.startswith("libc.so") else None

CHUNK_SCHEMA = "chunk long, n_bytes long, n_rows long, body binary"
BLOCK_SCHEMA = "chunk long, shard int, block binary"


def prepare(spark: SparkSession) -> SparkSession:
    """Session settings of these operators; sizes of the cluster stay as configured."""
    tune(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table."""
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


# --- packed arrays -------------------------------------------------------------------------------------------------


def squeeze(raw: bytes, level: int = 1) -> bytes:
    """zstd with the raw size in front."""
    return len(raw).to_bytes(8, "little") + pa.Codec("zstd", level).compress(raw, asbytes=True)


def unsqueeze(data: bytes) -> bytes:
    return pa.Codec("zstd").decompress(data[8:], int.from_bytes(data[:8], "little"), asbytes=True)


def pack(*arrays: np.ndarray, level: int = 1) -> bytes:
    """Arrays in one compressed block, byte planes apart, because high bytes repeat."""
    head = marshal.dumps([(a.dtype.str, len(a)) for a in arrays])
    planes = [np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.dtype.itemsize).T.tobytes() for a in arrays]
    return squeeze(len(head).to_bytes(4, "little") + head + b"".join(planes), level)


def unpack(block: bytes) -> list[np.ndarray]:
    raw = unsqueeze(block)
    at = 4 + int.from_bytes(raw[:4], "little")
    out = []
    for kind, n in marshal.loads(raw[4:at]):
        width = np.dtype(kind).itemsize
        planes = np.frombuffer(raw, np.uint8, n * width, at).reshape(width, n)
        out.append(np.ascontiguousarray(planes.T).reshape(-1).view(kind))
        at += n * width
    return out


def pack_keys(keys: np.ndarray, *values: np.ndarray, level: int = 1) -> bytes:
    """Sorted unsigned keys as differences, with values beside them."""
    return pack(np.diff(keys, prepend=keys.dtype.type(0)), *values, level=level)


def unpack_keys(block: bytes) -> list[np.ndarray]:
    steps, *values = unpack(block)
    return [np.cumsum(steps, dtype=steps.dtype), *values]


# --- chunks --------------------------------------------------------------------------------------------------------


def _freeze(pieces: list[pa.Table]) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, pieces[0].schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", BODY_LEVEL))) as writer:
        for piece in pieces:
            writer.write_table(piece)
    return sink.getvalue().to_pybytes()


def rows_of(body: bytes) -> pa.Table:
    """The rows of a chunk."""
    return pa.ipc.open_stream(pa.py_buffer(body)).read_all().combine_chunks()


def pieces_of(body: bytes) -> list[pa.Table]:
    """The rows of each piece of a chunk."""
    return [pa.Table.from_batches([b]) for b in pa.ipc.open_stream(pa.py_buffer(body))]


def make_chunks(df: DataFrame, store: Workspace, text: str = "text", chunk_bytes: int = CHUNK_BYTES, pieces: int = 1) -> DataFrame:
    """Rows of ``df``, all columns, in chunks of ``pieces`` pieces of at most ``chunk_bytes`` of ``text`` (or one row) each; written once."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trim()
        held: list[pa.RecordBatch] = []
        closed: list[pa.Table] = []
        size, whole, made = 0, 0, TaskContext.get().partitionId() << 32

        def close() -> None:
            nonlocal held, size, whole
            closed.append(pa.Table.from_batches(held).combine_chunks())
            held, size, whole = [], 0, whole + size

        def flush() -> pa.RecordBatch:
            nonlocal closed, whole, made
            out = pa.RecordBatch.from_pylist(
                [{"chunk": made, "n_bytes": whole, "n_rows": sum(t.num_rows for t in closed), "body": _freeze(closed)}],
                schema=pa.schema([("chunk", pa.int64()), ("n_bytes", pa.int64()), ("n_rows", pa.int64()), ("body", pa.binary())]))
            closed, whole, made = [], 0, made + 1
            return out

        for batch in batches:
            lengths = np.fromiter((len(x.as_buffer()) if x.is_valid else 0 for x in batch.column(text)), np.int64, batch.num_rows)
            start = 0
            for i, n in enumerate(lengths.tolist()):
                if size and size + n > chunk_bytes:
                    if i > start:
                        held.append(batch.slice(start, i - start))
                    start = i
                    close()
                    if len(closed) == pieces:
                        yield flush()
                size += n
            if start < batch.num_rows:
                held.append(batch.slice(start))
            if sum(b.num_rows for b in held) >= MAX_ROWS:
                close()
                if len(closed) == pieces:
                    yield flush()
        if held:
            close()
        if closed:
            yield flush()

    return store.keep(df.mapInArrow(cut, CHUNK_SCHEMA), "chunks")


_held: list[Callable[[], None]] = []


def hold(forget: Callable[[], None]) -> None:
    """Keep what ``forget`` drops for the tasks of one step; the first other work of this Python worker drops it."""
    if forget not in _held:
        _held.append(forget)


def trim() -> None:
    """Give freed memory of this Python worker back: it stays for later stages, and several share an executor."""
    while _held:
        _held.pop()()
    pa.default_memory_pool().release_unused()
    if hasattr(_libc, "malloc_trim"):
        _libc.malloc_trim(0)


def release(spark: SparkSession) -> None:
    """Let Spark remove the shuffle files of finished steps whose frames are gone.

    It removes them when the driver's JVM collects its garbage, which may take half an hour by itself.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def shards_for(chunks: DataFrame, key_bytes: float, shard_bytes: int = SHARD_BYTES) -> int:
    """Shards so that one sees ``shard_bytes`` of keys; ``key_bytes``: bytes of keys per byte of text."""
    total = chunks.agg(F.sum("n_bytes")).first()[0] or 0
    return max(8, int(total * key_bytes / shard_bytes) + 1)


def shard_of(keys: np.ndarray, shards: int) -> np.ndarray:
    """Shard of 64-bit keys by their high 32 bits, ascending with the key."""
    return ((keys >> np.uint64(32)) * np.uint64(shards)) >> np.uint64(32)


def split_shards(keys: np.ndarray, shards: int) -> list[tuple[int, slice]]:
    """Ranges of sorted keys that belong to one shard each."""
    of = shard_of(keys, shards)
    starts = np.flatnonzero(np.diff(of, prepend=np.uint64(2**63)))
    ends = np.append(starts[1:], len(of))
    return [(int(of[a]), slice(int(a), int(b))) for a, b in zip(starts, ends)]


def ask(chunks: DataFrame, emit: Callable[[pa.Table], tuple[np.ndarray, ...]], shards: int, level: int = 1) -> DataFrame:
    """One block per chunk and shard. ``emit`` gives sorted distinct 64-bit keys of a chunk and values beside them."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, body in zip(batch.column("chunk").to_pylist(), batch.column("body")):
                keys, *values = emit(rows_of(body.as_buffer()))
                if not len(keys):
                    continue
                parts = [(s, pack_keys(keys[r], *(v[r] for v in values), level=level)) for s, r in split_shards(keys, shards)]
                yield blocks(chunk, parts)
                del keys, values, parts
                trim()

    return chunks.select("chunk", "body").mapInArrow(send, BLOCK_SCHEMA)


def blocks(chunk: int, parts: list[tuple[int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([chunk] * len(parts), pa.int64()), pa.array([s for s, _ in parts], pa.int32()), pa.array([b for _, b in parts], pa.binary())],
        names=["chunk", "shard", "block"])


def gather(group: pa.Table) -> tuple[np.ndarray, np.ndarray, list[np.ndarray], list[int]]:
    """Blocks of one shard as long arrays: index of the block, key, values; and the chunk of each block."""
    found = [unpack_keys(b.as_buffer()) for b in group.column("block")]
    of = np.repeat(np.arange(len(found), dtype=np.int32), [len(x[0]) for x in found])
    columns = [np.concatenate(x) for x in zip(*found)]
    del found
    return of, columns[0], columns[1:], group.column("chunk").to_pylist()


def answer(asked: DataFrame, reply: Callable[[np.ndarray, np.ndarray, list[np.ndarray]], list[np.ndarray]]) -> DataFrame:
    """Answers per chunk and shard. ``reply(block index, keys, values)`` gives index, key and result arrays to send back."""

    def run(group: pa.Table) -> pa.Table:
        shard = group.column("shard")[0].as_py()
        of, keys, values, chunks = gather(group)
        back, kept, *results = reply(of, keys, values)
        order = np.lexsort((kept, back))
        back, kept, results = back[order], kept[order], [r[order] for r in results]
        out, bounds = [], np.searchsorted(back, np.arange(len(chunks) + 1))
        for i, chunk in enumerate(chunks):
            a, b = bounds[i], bounds[i + 1]
            if b > a:
                out.append(blocks(chunk, [(shard, pack_keys(kept[a:b], *(r[a:b] for r in results)))]))
        del of, keys, values, back, kept, results
        trim()
        return pa.Table.from_batches(out, schema=blocks(0, []).schema)

    return asked.groupBy("shard").applyInArrow(run, BLOCK_SCHEMA)


def meet(chunks: DataFrame, answers: DataFrame, use: Callable[..., pa.Table], schema, with_chunk: bool = False) -> DataFrame:
    """``use(rows of the chunk, keys and results in key order or None)`` for every chunk; its number in front on demand."""

    def run(key, left, right):
        made = []
        for body in left.column("body"):
            found = None
            if right.num_rows:
                order = np.argsort(right.column("shard").to_numpy())
                got = [unpack_keys(right.column("block")[int(i)].as_buffer()) for i in order]
                found = [np.concatenate(x) for x in zip(*got)]
            made.append(use(*([key[0].as_py()] if with_chunk else []), rows_of(body.as_buffer()), found))
        trim()
        return pa.concat_tables(made)

    return chunks.select("chunk", "body").groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(run, schema)


def arrow_schema(ddl: str) -> pa.Schema:
    """Arrow types of a Spark schema text of plain columns."""
    kinds = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string(), "boolean": pa.bool_(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64())}
    return pa.schema([(n, kinds[k]) for n, k in (x.strip().split(" ", 1) for x in ddl.split(","))])


def texts_of(rows: pa.Table, column: str = "text") -> list[bytes]:
    """UTF-8 of a string column; null as empty."""
    col = rows.column(column)
    col = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    return [x or b"" for x in col.cast(pa.large_binary()).to_pylist()]
