"""Trie of conversations by their turns, built by halving the depth (van Emde Boas order).

A row is one turn of one conversation: never an array of turns, so that a conversation with a third of all turns is
spread over tasks like any other rows. The depth range is cut at half; the prefix that ends at the cut gets a name; what
stands above the cut is the upper trie, and below every named prefix hangs a lower trie. Both halves are cut again,
in parallel for all ranges of one size:

* Blocks. Names of 2, 4, 8, ... neighbouring turns are made from the names of their halves (``blocks``).
* Names. From the widest range to the narrowest, the prefix at the middle of each range is named from the prefix at its
  start and the block between (``prefixes``). After the last cut every prefix has a name; equal names are one node.
* Grafting. From the narrowest range to the widest, the totals of the lower tries are added to the nodes above them:
  each root of a lower trie hands its totals to its ancestors in the upper trie of the same range (``totals``). Every
  size of range hands on at most one row per turn, and ranges longer than a conversation don't see it.

Names are 128-bit hashes, so that naming needs no numbering of all prefixes. A node is given as its smallest
member and its depth, which is unique.

Defined cases: null role or text is empty; a null turn comes first; rows with the same turn are ordered by role and md5 of
the text, equal rows are turns of their own; rows without conv_id belong to no conversation; an empty table has no nodes; other
columns don't matter. The ids of all conversations that end at a node are one hashed text: pieces of it are put
together by many tasks, and the hash is fed piece by piece.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from taktline.llm import chunks as C
from taktline.operators.ordering import running_number
from taktline.workspace import Workspace

SHARED = 100  # conversations that share the head of the first one of them
HEADS = 6  # a head has fewer turns
BLOCK = 1000  # turn numbers of one conversation that one task sorts
PIECE = 8192  # ids in one piece of a hashed list
NAME = ["a", "b"]
PIECES = "a long, b long, first long, ids string"
HASHES = "a long, b long, ends_sha256 string"


def _name(*parts: Column | str) -> list[Column]:
    """A 128-bit name of the parts, as two columns."""
    return [F.xxhash64(F.lit(1), *parts).alias("a"), F.xxhash64(F.lit(2), *parts).alias("b")]


def _long(column: Column | str) -> Column:
    return F.col(column).cast("long") if isinstance(column, str) else column.cast("long")


def ordered_turns(rows: DataFrame) -> DataFrame:
    """(conv_id, pos from 0, name and size of the turn) of rows (conv_id, turn, role, text)."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    turns = rows.filter("conv_id IS NOT NULL").select(
        _long("conv_id").alias("conv_id"), _long("turn").alias("turn"), role.alias("role"), F.md5(text).alias("digest"), _long(F.length(text)).alias("size"))
    # Without turn numbers the next parts of the order cut a long conversation.
    block = F.struct(F.floor(F.col("turn") / BLOCK).alias("t"), F.when(F.col("turn").isNull(), F.struct("role", F.substring("digest", 1, 2))).alias("r"))
    numbered = running_number(turns, ["conv_id"], [F.col("turn").asc_nulls_first(), F.col("role"), F.col("digest")], block, "pos")
    return numbered.select("conv_id", _long(F.col("pos") - 1).alias("pos"), *_name("role", "digest"), "size")


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns of all conversations behind their shared heads; and length per conversation, also of those without turns."""
    convs = turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("own"))
    convs = convs.withColumns({"_base": F.col("conv_id") - F.col("conv_id") % SHARED, "h": F.crc32(F.col("conv_id").cast("string").cast("binary")) % HEADS})
    heads = turns.filter((F.col("conv_id") % SHARED == 0) & (F.col("pos") < HEADS - 1))
    heads = heads.groupBy(F.col("conv_id").alias("_base")).agg(F.sort_array(F.collect_list(F.struct("pos", "a", "b", "size"))).alias("head"))  # five turns
    none = F.array().cast("array<struct<pos: long, a: long, b: long, size: long>>")
    convs = convs.join(heads, "_base", "left").withColumn("head", F.slice(F.coalesce("head", none), F.lit(1), F.col("h").cast("int")))
    shared = convs.select("conv_id", F.explode("head").alias("t")).select("conv_id", "t.*")
    kept = convs.select("conv_id", "h", F.size("head").cast("long").alias("n_head"), "own")
    rest = turns.join(kept.drop("own"), "conv_id").filter("pos >= h").select("conv_id", (F.col("pos") - F.col("h") + F.col("n_head")).alias("pos"), "a", "b", "size")
    lengths = kept.select("conv_id", (F.col("n_head") + F.greatest(F.col("own") - F.col("h"), F.lit(0))).alias("length"))
    return shared.unionByName(rest), lengths


def blocks(turns: DataFrame, levels: int, store: Workspace) -> list[DataFrame]:
    """Names of all whole aligned blocks of 1, 2, 4, ... turns: (conv_id, i, a, b)."""
    made = [turns.select("conv_id", F.col("pos").alias("i"), "a", "b")]
    half = lambda odd, c: F.max(F.when(F.col("i") % 2 == odd, F.col(c)))
    for level in range(1, levels):
        pairs = made[-1].groupBy("conv_id", F.shiftright("i", 1).alias("_i")).agg(*(half(odd, c).alias(f"{c}{odd}") for odd in (0, 1) for c in NAME), F.count(F.lit(1)).alias("n"))
        made.append(store.keep(pairs.filter("n = 2").select("conv_id", F.col("_i").alias("i"), *_name("a0", "b0", "a1", "b1")), f"blocks-{level}"))
    return made


def prefixes(lengths: DataFrame, named: list[DataFrame], store: Workspace) -> DataFrame:
    """Name of every prefix: (conv_id, depth, a, b)."""
    found = lengths.select("conv_id", F.lit(0).cast("long").alias("depth"), *_name(F.lit("root")))
    for level in reversed(range(len(named))):
        block = named[level].filter("i % 2 = 0").select("conv_id", F.shiftleft("i", level).alias("depth"), F.col("a").alias("a1"), F.col("b").alias("b1"))
        middle = found.join(block, ["conv_id", "depth"]).select("conv_id", (F.col("depth") + (1 << level)).alias("depth"), *_name("a", "b", "a1", "b1"))
        found = found.unionByName(store.keep(middle, f"prefixes-{level}"))
    return found


def nodes_of(found: DataFrame, turns: DataFrame, store: Workspace) -> DataFrame:
    """One row per node with its parent's name, members, children and own share of saved text."""
    nodes = store.keep(found.groupBy("a", "b").agg(F.min("conv_id").alias("conv_id"), F.max("depth").alias("depth"), F.count(F.lit(1)).alias("n_convs")), "nodes")
    above = found.select("conv_id", (F.col("depth") + 1).alias("depth"), F.col("a").alias("pa"), F.col("b").alias("pb"))
    last = turns.select("conv_id", (F.col("pos") + 1).alias("depth"), "size")
    nodes = store.keep(nodes.join(above, ["conv_id", "depth"], "left").join(last, ["conv_id", "depth"], "left"), "linked")
    children = nodes.filter("pa IS NOT NULL").groupBy(F.col("pa").alias("a"), F.col("pb").alias("b")).agg(F.count(F.lit(1)).alias("n_children"))
    full = nodes.join(children, NAME, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long")))
    return full.withColumn("saved", (F.col("n_convs") - 1) * F.coalesce("size", F.lit(0).cast("long"))).drop("size")


def totals(nodes: DataFrame, found: DataFrame, levels: int, store: Workspace) -> DataFrame:
    """Leaves and saved text of each node's subtree: (a, b, n_leaves, saved_tokens)."""
    total = nodes.select("a", "b", "conv_id", "depth", (F.col("n_children") == 0).cast("long").alias("n_leaves"), F.col("saved").alias("saved_tokens"))
    for level in range(levels):
        size = 1 << level
        roots = total.filter(F.col("depth") % (2 * size) == size)
        handed = roots.select("conv_id", F.explode(F.sequence(F.col("depth") - size, F.col("depth") - 1)).alias("depth"), "n_leaves", "saved_tokens")
        upper = found.filter(F.col("depth") % (2 * size) < size)
        grafts = handed.join(upper, ["conv_id", "depth"]).groupBy(*NAME).agg(F.sum("n_leaves").alias("_leaves"), F.sum("saved_tokens").alias("_saved"))
        more = lambda c, d: (F.col(c) + F.coalesce(d, F.lit(0).cast("long"))).alias(c)
        total = store.keep(total.join(grafts, NAME, "left").select("a", "b", "conv_id", "depth", more("n_leaves", "_leaves"), more("saved_tokens", "_saved")), f"totals-{level}")
    return total.select("a", "b", "n_leaves", "saved_tokens")


def end_hashes(found: DataFrame, lengths: DataFrame, piece: int = PIECE) -> DataFrame:
    """SHA-256 of the ascending ids of the conversations that end at a node, for nodes with such conversations."""
    ends = found.join(lengths, "conv_id").filter("depth = length").select("a", "b", "conv_id")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = C.arrow_schema(PIECES)
        for batch in batches:
            a, b, ids = (batch.column(i).to_pylist() for i in range(3))
            rows, start = [], 0
            for i in range(1, len(ids) + 1):
                if i == len(ids) or i - start == piece or a[i] != a[start] or b[i] != b[start]:
                    rows.append({"a": a[start], "b": b[start], "first": ids[start], "ids": ",".join(map(str, ids[start:i]))})
                    start = i
            yield pa.RecordBatch.from_pylist(rows, schema=kinds)

    def feed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds, key, state = C.arrow_schema(HASHES), None, None
        for batch in batches:
            done = []
            for a, b, ids in zip(*(batch.column(n).to_pylist() for n in ("a", "b", "ids"))):
                if key != (a, b):
                    if key:
                        done.append((*key, state.hexdigest()))
                    key, state = (a, b), hashlib.sha256(ids.encode())
                else:
                    state.update(b"," + ids.encode())
            yield pa.RecordBatch.from_pylist([dict(zip(kinds.names, x)) for x in done], schema=kinds)
        if key:
            yield pa.RecordBatch.from_pylist([dict(zip(kinds.names, (*key, state.hexdigest())))], schema=kinds)

    pieces = ends.repartitionByRange("a", "b", "conv_id").sortWithinPartitions("a", "b", "conv_id").mapInArrow(cut, PIECES)
    return pieces.repartition("a", "b").sortWithinPartitions("a", "b", "first").mapInArrow(feed, HASHES)


def trie(rows: DataFrame, store: Workspace, piece: int = PIECE) -> DataFrame:
    """All nodes of the trie of rows (conv_id, turn, role, text)."""
    turns, lengths = rebuilt(store.keep(ordered_turns(rows), "ordered"))
    turns, lengths = store.keep(turns, "turns"), store.keep(lengths, "lengths")
    levels = int(lengths.agg(F.max("length")).first()[0] or 0).bit_length()
    found = prefixes(lengths, blocks(turns, levels, store)[:levels], store)
    nodes = store.keep(nodes_of(found, turns, store), "counted")
    parents = nodes.select(F.col("a").alias("pa"), F.col("b").alias("pb"), F.col("conv_id").alias("parent_conv_id"))
    out = nodes.join(totals(nodes, found, levels, store), NAME).join(end_hashes(found, lengths, piece), NAME, "left").join(parents, ["pa", "pb"], "left")
    nothing = F.lit(hashlib.sha256(b"").hexdigest())
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", nothing).alias("ends_sha256"))


def op13_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trie of all conversations behind shared heads."""
    return trie(C.table(spark, sf_dir, "conversations"), Workspace(spark))


#: crc32 of an ASCII text, bit by bit.
CRC32 = """xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split({0}, ''), lambda x: ascii(x)::BIGINT)),
  lambda c, x: list_reduce(list_prepend(xor(c, x), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda d, k: CASE WHEN d % 2 = 1 THEN xor(d // 2, 3988292384) ELSE d // 2 END)))"""

SQL = f"""
WITH t AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), md5(coalesce(text, ''))) - 1 AS pos
  FROM conversations WHERE conv_id IS NOT NULL),
own AS (
  SELECT conv_id, list({{'key': md5(length(role) || '/' || role || '/' || text), 'size': length(text)}} ORDER BY pos) AS turns,
    ({CRC32.format("CAST(conv_id AS VARCHAR)")} % {HEADS})::INT AS h
  FROM t GROUP BY conv_id),
r AS (
  SELECT c.conv_id, list_concat(coalesce(b.turns[1:c.h], []), c.turns[c.h + 1:]) AS turns
  FROM own c LEFT JOIN own b ON b.conv_id = c.conv_id - c.conv_id % {SHARED}),
p AS (
  SELECT conv_id, depth, len(turns) AS length, md5(array_to_string(list_transform(turns[1:depth], lambda x: x.key), '')) AS name,
    md5(array_to_string(list_transform(turns[1:depth - 1], lambda x: x.key), '')) AS parent, CASE WHEN depth > 0 THEN turns[depth].size ELSE 0 END AS size
  FROM (SELECT conv_id, turns, unnest(range(len(turns) + 1)) AS depth FROM r)),
n AS (
  SELECT name, min(conv_id) AS conv_id, max(depth) AS depth, count(*) AS n_convs, max(size) AS size, CASE WHEN max(depth) > 0 THEN max(parent) END AS parent,
    sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (depth = length), '')) AS ends_sha256
  FROM p GROUP BY name),
k AS (SELECT parent, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY parent),
f AS (SELECT n.*, coalesce(k.n_children, 0) AS n_children, (n.n_convs - 1) * n.size AS saved FROM n LEFT JOIN k ON k.parent = n.name),
s AS (
  SELECT p.name, sum((f.n_children = 0)::INT)::BIGINT AS n_leaves, sum(f.saved)::BIGINT AS saved_tokens
  FROM f JOIN p ON p.conv_id = f.conv_id AND p.depth <= f.depth GROUP BY p.name)
SELECT f.conv_id, f.depth, u.conv_id AS parent_conv_id, f.n_convs, f.n_children, s.n_leaves, s.saved_tokens, f.ends_sha256
FROM f JOIN s USING (name) LEFT JOIN n u ON u.name = f.parent
"""

QUERIES = {"op13_conversation_trie": op13_conversation_trie}
ORACLES = {"op13_conversation_trie": SQL}
