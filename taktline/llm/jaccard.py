"""N-gram Jaccard join by grouped prefixes.

A document is the set of its distinct shingles (runs of ``width`` words, A-Z lower-cased). Two documents link when the
share of common shingles reaches ``percent``.

1. Every shingle is counted over all documents. Shingles are ordered by that count, then by hash, the same for all.
2. A document's prefix is its first n - ceil(percent * n) + 1 shingles. Two documents that link share one of these, so
   that shingles found in one document only drop out; most documents drop out with them.
3. Documents with equal sets are one; those with equal prefixes and sizes are one group.
4. Groups that share a prefix shingle are candidates. In a few rounds each first meets one group of the least and one of
   the largest component of each shingle, and each member the least of its group; verified links give components. Then
   groups of different components that share
   shingles meet, filtered by sizes and by the places of the shared shingle, and before texts are read by the number of
   common prefix shingles, which bounds the overlap from above. Last, these are expanded: members of different
   components are verified pair by pair. No pair that could join two components is left out, and no group of copies is
   compared with itself.

Shingles are 64-bit hashes; the chance that any two of a pair of documents collide is below n^2 / 2^64.

Defined cases: a document without words or with a null text has no shingles and is linked with nothing; one with fewer
words than ``width`` has its whole sequence as its only shingle; a null doc_id is passed on and never the least id unless
a component has no other; equal rows are documents of their own and link; an empty table gives no rows; other columns
don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from taktline.llm import chunks as C
from taktline.llm.components import components
from taktline.llm.words import SEED, mix, run_hashes, word_hashes
from taktline.workspace import Workspace

WIDTH = 4
PERCENT = 85
STAR_ROUNDS = 2  # more of these leave fewer components for the last steps; the result is the same
COUNT_BITS = 9  # bits of a counting key beyond those of the corpus size
KEY_BYTES = 1.4  # bytes of counting keys per byte of text, about
FOUND = "rid long, doc_id long, n long, h1 long, h2 long, p int, tokens array<long>, places array<long>, body binary"


def shingles(text: bytes, width: int) -> np.ndarray:
    """Sorted distinct shingle hashes."""
    return np.unique(run_hashes(word_hashes(text.lower().split()), width))


def prefix_size(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1


def links(common: int, n: int, m: int, percent: int) -> bool:
    return common > 0 and 100 * common >= percent * (n + m - common)


def _mask(bits: int) -> np.uint64:
    return np.uint64((2**64 - 1) ^ (2 ** (64 - bits) - 1))


def prefixes(chunks: DataFrame, width: int, percent: int) -> DataFrame:
    """Per row: size and hash of the set, shared prefix shingles and, if there are any, the text."""
    total = chunks.agg(F.sum("n_bytes")).first()[0] or 0
    mask = _mask(min(64, max(32, total.bit_length() + COUNT_BITS)))

    def emit(rows: pa.Table):
        sets = [shingles(t, width) & mask for t in C.texts_of(rows)]
        keys, counts = np.unique(np.concatenate(sets) if sets else np.empty(0, np.uint64), return_counts=True)
        return keys, counts.astype(np.uint16)

    def count(of, keys, values):
        order = np.argsort(keys, kind="stable")
        keys, of, counts = keys[order], of[order], values[0][order].astype(np.int64)
        if not len(keys):
            return of, keys, counts
        starts = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
        sums = np.repeat(np.add.reduceat(counts, starts), np.diff(np.append(starts, len(keys))))
        shared = sums > 1
        return of[shared], keys[shared], sums[shared].astype(np.uint64)

    def use(chunk: int, rows: pa.Table, found) -> pa.Table:
        known, total_of = found if found is not None else (np.empty(0, np.uint64), np.empty(0, np.uint64))
        base = ((chunk >> 32) << 40) | ((chunk & 0xFFFFFFFF) << 16)
        out = []
        for i, (doc, text) in enumerate(zip(rows.column("doc_id").cast(pa.int64()).to_pylist(), C.texts_of(rows))):
            own = shingles(text, width)
            n = len(own)
            row = [base | i, doc, n, 0, 0, 0, None, None, None]
            if n and len(known):
                at = np.minimum(np.searchsorted(known, own & mask), len(known) - 1)
                times = np.where(known[at] == own & mask, total_of[at], np.uint64(1))
                p = prefix_size(n, percent)
                first = np.lexsort((own, times))[:p]
                places = np.flatnonzero(times[first] > 1)
                if len(places):
                    row[3:] = [int(np.add.reduce(mix(own)).view(np.int64)), int(np.bitwise_xor.reduce(mix(own ^ SEED)).view(np.int64)), p, own[first[places]].view(np.int64), places + 1, C.squeeze(text)]
            out.append(row)
        schema = C.arrow_schema(FOUND)
        return pa.table([pa.array(c, f.type) for c, f in zip(list(zip(*out)) or [()] * len(schema), schema)], schema=schema)

    shards = C.shards_for(chunks, KEY_BYTES)
    return C.meet(chunks, C.answer(C.ask(chunks, emit, shards), count), use, FOUND, with_chunk=True)


def verify(pairs: DataFrame, found: DataFrame, width: int, percent: int) -> DataFrame:
    """Those of the pairs (a, b) of rows that link, by their whole sets."""
    side = lambda k: found.select(F.col("rid").alias(k), *(F.col(c).alias(f"{c}_{k}") for c in ("n", "p", "tokens", "body")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple = (None, None)
        for batch in batches:
            keep = []
            for r in batch.to_pylist():
                n, m = r["n_a"], r["n_b"]
                shared = len(set(r["tokens_a"]).intersection(r["tokens_b"]))
                if not links(min(n, m, shared + max(n - r["p_a"], m - r["p_b"])), n, m, percent):
                    keep.append(False)
                    continue
                if last[0] != r["b"]:
                    last = (r["b"], shingles(C.unsqueeze(r["body_b"]), width))
                common = len(np.intersect1d(shingles(C.unsqueeze(r["body_a"]), width), last[1], assume_unique=True))
                keep.append(links(common, n, m, percent))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))
        C.trim()

    return pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", *(f"{c}_{k}" for c in ("n", "p", "tokens", "body") for k in ("a", "b"))).mapInArrow(run, "a long, b long")


def _near(n: str, m: str, percent: int):
    return (F.lit(100) * F.least(n, m) >= F.lit(percent) * F.greatest(n, m))


def _stars(rows: DataFrame, percent: int) -> DataFrame:
    """A few pairs (a, b) of rows (node, comp, n, tokens) that probably link, for a start.

    Per shingle, rows meet one row of the least and one of the largest component, and each keeps the two it shares most
    with. There are no more than two pairs per row.
    """
    spread = rows.select("node", "comp", "n", F.explode("tokens").alias("token"))
    key = F.struct("comp", "node")
    ends = spread.groupBy("token").agg(F.min_by(F.struct("node", "comp", "n"), key).alias("low"), F.max_by(F.struct("node", "comp", "n"), key).alias("high"))
    ends = ends.filter("low.comp <> high.comp").select("token", F.explode(F.array("low", "high")).alias("hub"))
    met = spread.join(ends, "token").filter((F.col("comp") != F.col("hub.comp")) & _near("n", "hub.n", percent))
    counted = met.groupBy(F.col("node").alias("a"), F.col("hub.node").alias("b")).agg(F.count(F.lit(1)).alias("shared"))
    rank = F.struct("shared", F.negative("b"))
    best = counted.groupBy("a").agg(F.max_by("b", rank).alias("first"), F.max(rank).alias("top"))
    second = counted.join(best, "a").filter("b <> first").groupBy("a").agg(F.max_by("b", rank).alias("b"))
    return best.select("a", F.col("first").alias("b")).unionByName(second.select("a", "b"))


def _across(rows: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of rows (node, comp, n, tokens, places) of different components that may link.

    A pair that links has ``least`` shingles in common at least, so that already the first n - least + 1 of either side
    share one.
    """
    spread = rows.select("node", "comp", "n", F.explode(F.arrays_zip("tokens", "places")).alias("t")).select("node", "comp", "n", F.col("t.tokens").alias("token"), F.col("t.places").alias("place"))
    mixed = spread.groupBy("token").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).filter("low <> high").select("token")
    spread = spread.join(mixed, "token", "left_semi")
    left, right = (spread.select("token", *(F.col(c).alias(f"{c}_{k}") for c in ("node", "comp", "n", "place"))) for k in ("a", "b"))
    least = F.expr(f"({percent} * (n_a + n_b) + {99 + percent}) DIV {100 + percent}")
    early = (F.col("place_a") <= F.col("n_a") - least + 1) & (F.col("place_b") <= F.col("n_b") - least + 1)
    met = left.join(right, "token").filter((F.col("comp_a") < F.col("comp_b")) & _near("n_a", "n_b", percent) & early)
    return met.select(F.col("node_a").alias("a"), F.col("node_b").alias("b")).distinct()


def _linked(chunks: DataFrame, store: Workspace, width: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """All rows with their sizes, and those that share a prefix shingle with others: (rid, doc_id, n, comp)."""
    found = store.keep(prefixes(chunks, width, percent), "prefixes")
    joint = found.filter("tokens IS NOT NULL")
    sets = store.keep(joint.groupBy("n", "h1", "h2").agg(F.min("rid").alias("rid")), "sets")
    one = store.keep(found.join(sets.select("rid"), "rid", "left_semi"), "distinct-sets")
    # Groups: equal prefixes and sizes. A group is named by its least member.
    keyed = one.select("rid", "n", "tokens", "places", F.xxhash64("tokens", "places").alias("g1"), F.hash("tokens", "places").alias("g2"))
    groups = keyed.groupBy("n", "g1", "g2").agg(F.min("rid").alias("gid"))
    member = store.keep(keyed.join(groups, ["n", "g1", "g2"]).select("rid", "gid", "n", "tokens", "places"), "members")
    heads = member.filter("rid = gid").select(F.col("rid").alias("node"), F.col("rid").alias("comp"), "n", "tokens")
    inside = member.filter("rid <> gid").select(F.col("rid").alias("a"), F.col("gid").alias("b"))
    edges = store.keep(verify(_stars(heads, percent).unionByName(inside), one, width, percent), "links")
    for level in (*["stars"] * STAR_ROUNDS, "groups", "members"):
        comp = components(edges, store)
        rows = store.keep(member.join(comp, member.rid == comp.node, "left").select("rid", "gid", "n", "tokens", "places", F.coalesce("component", "rid").alias("comp")), "nodes")
        if level == "members":
            rows = rows.withColumnRenamed("rid", "node")
        else:
            # Members of a group that are in one component stand together.
            rows = rows.groupBy("gid", "comp").agg(F.min("rid").alias("node"), *(F.min_by(c, "rid").alias(c) for c in ("n", "tokens", "places")))
        pairs = _stars(rows, percent) if level == "stars" else _across(rows, percent)
        edges = edges.unionByName(store.keep(verify(pairs, one, width, percent), "links"))
    comp = components(edges, store)
    of_set = sets.join(comp, sets.rid == comp.node, "left").select("n", "h1", "h2", F.coalesce("component", "rid").alias("comp"))
    return found, store.keep(joint.select("rid", "doc_id", "n", "h1", "h2").join(of_set, ["n", "h1", "h2"]).select("rid", "doc_id", "n", "comp"), "components")


def similar_components(docs: DataFrame, store: Workspace, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id) per row of (doc_id, text)."""
    chunks = C.make_chunks(docs.selectExpr("cast(doc_id AS long) AS doc_id", "cast(text AS string) AS text"), store)
    found, placed = _linked(chunks, store, width, percent)
    least = placed.groupBy("comp").agg(F.min("doc_id").alias("component_id"))
    linked = placed.join(least, "comp").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    alone = found.filter("tokens IS NULL").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return linked.unionByName(alone)


def one_of_each(docs: DataFrame, store: Workspace, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """The rows without those that are similar to a row with a smaller doc_id; all columns. Rows without words stay."""
    chunks = C.make_chunks(docs, store)
    _, placed = _linked(chunks, store, width, percent)
    stays = placed.groupBy("comp").agg(F.min_by("rid", F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "rid")).alias("rid"))
    gone = placed.join(stays, ["comp", "rid"], "left_anti").select(F.expr("shiftleft(shiftright(rid, 40), 32) + (shiftright(rid, 16) & 16777215)").alias("chunk"), (F.col("rid").bitwiseAND(F.lit(65535))).alias("row"))
    lists = gone.groupBy("chunk").agg(F.collect_list("row").alias("gone"))  # rows of one chunk at most

    def drop(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for body, out in zip(batch.column("body"), batch.column("gone").to_pylist()):
                rows = C.rows_of(body.as_buffer())
                stay = np.ones(rows.num_rows, bool)
                stay[out or []] = False
                yield from rows.filter(pa.array(stay)).to_batches()

    return chunks.join(lists, "chunk", "left").select("body", "gone").mapInArrow(drop, docs.schema)


def op4_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of all documents."""
    return similar_components(C.table(spark, sf_dir, "documents"), Workspace(spark))


SQL = rf"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS r, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
s AS (
  SELECT DISTINCT r, array_to_string(w[i:i+{WIDTH - 1}], ' ') AS g
  FROM (SELECT r, w, unnest(range(1, greatest(len(w) - {WIDTH - 1}, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT r, count(*) AS n FROM s GROUP BY r),
p AS (SELECT a.r AS a, b.r AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.r < b.r GROUP BY a.r, b.r),
e AS (SELECT a, b FROM p JOIN n x ON x.r = a JOIN n y ON y.r = b WHERE 100 * c >= {PERCENT} * (x.n + y.n - c)),
u AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
reach AS (SELECT r, r AS t FROM d UNION SELECT reach.r, u.b FROM reach JOIN u ON u.a = reach.t)
SELECT d.doc_id, coalesce(any_value(n.n), 0)::BIGINT AS n_shingles, min(o.doc_id) AS component_id
FROM d JOIN reach ON reach.r = d.r JOIN d o ON o.r = reach.t LEFT JOIN n ON n.r = d.r GROUP BY d.r, d.doc_id
"""

QUERIES = {"op4_ngram_jaccard_join": op4_ngram_jaccard_join}
ORACLES = {"op4_ngram_jaccard_join": SQL}
