"""Best-fit packing of documents into sequences by a grouping genetic algorithm on islands.

Tokens: ids of the tokenizer, then one end id. Documents longer than a sequence are cut into full pieces and a rest.

A solution is a list of bins (sequences), and bins are what is inherited. Crossover injects well-filled bins of one
parent into a copy of the other, removes every bin of the copy that shares a piece with them, and places the displaced
pieces by best fit, largest first. Pieces are dealt to islands of a bounded size; each island evolves a small population.
Then bins that are full enough are final, and all other pieces are dealt anew to fewer islands, together with the elite
of the neighbour island: its best bins as lists of lengths, which the island fills with pieces of its own and injects
like a parent. The rounds end with one island, or when every bin is final. Islands hold a bounded number of pieces, whatever the corpus.

Defined cases: a null or empty text is the end id alone; a null doc_id is passed on; equal rows are packed each on its
own; an empty table gives no rows; other columns don't matter.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from taktline.llm import chunks as C
from taktline.workspace import Workspace

CAPACITY = 4096
END_ID = 1
ISLAND = 8192  # pieces on one island
POPULATION = 4
GENERATIONS = 8
ELITE = 32  # bins that an island sends to its neighbour
FULL = (0.995, 0.98, 0.95, 0.9, 0.8, 0.6, 0.0)  # per round: share of a sequence from which a bin is final
CACHED = 300_000  # words of one generation kept with their ids in one Python worker; there are two
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PACKED = PIECES + ", sequence_id long, offset long"

# Beyond these, case mapping, composition and white space are left to the tokenizer.
_ODD = re.compile("[^\\x00-\\x1b\\x20-\\x84\\x86-\\x9f\\xa1-\\u012f\\u0131-\\u017f\\u2010-\\u2027\\u2030-\\u205e]")

_PRETOKEN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")  # of the tokenizer file


class WordEncoder:
    """Packed ids per text. The tokenizer drops white space, so that words can be encoded one by one and remembered."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        vocabulary = self.tokenizer.get_vocab()
        # Each pre-token ends with just one id of a word end.
        self.is_end = np.zeros(max(vocabulary.values()) + 1, bool)
        self.is_end[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")

    def _remember(self, missing: list[str]) -> None:
        """Ids of new words, all in one text; by the number of pre-tokens of each, the ids fall apart again."""
        counts = np.array([len(_PRETOKEN.findall(w)) for w in missing])
        ids = self._ids(" ".join(missing))
        ends = np.append(0, np.flatnonzero(self.is_end[ids]) + 1)
        if len(ends) - 1 != counts.sum():
            raise ValueError("words and their ids don't match")
        cuts = (4 * ends[np.append(0, np.cumsum(counts))]).tolist()
        packed = ids.tobytes()
        self.known.update((w, packed[a:b]) for w, a, b in zip(missing, cuts, cuts[1:]))

    def encode_all(self, texts: list[str]) -> list[bytes]:
        words = [None if _ODD.search(t) else t.lower().split() for t in texts]
        missing = set(chain.from_iterable(w for w in words if w)) - self.known.keys()
        if missing:
            if len(self.known) + len(missing) > CACHED:
                # The words of before are an older generation, from which those in use come back.
                used = set(chain.from_iterable(w for w in words if w))
                self.older, self.known = self.known, {w: self.known[w] for w in used & self.known.keys()}
            back = missing & self.older.keys()
            self.known.update((w, self.older[w]) for w in back)
            if missing := list(missing - back):
                self._remember(missing)
        get = self.known.__getitem__
        return [self._ids(t).tobytes() if w is None else b"".join(map(get, w)) for t, w in zip(texts, words)]

    def encode(self, text: str) -> bytes:
        return self.encode_all([text])[0]


@lru_cache(2)
def word_encoder(vocabulary: str | None) -> WordEncoder:
    import os

    import public_tokenizers

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return WordEncoder(vocabulary or public_tokenizers.path("word_bpe_49k.json"))


def cut_pieces(docs: DataFrame, vocabulary: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """Pieces of every document with their place and checksum."""
    schema = C.arrow_schema(PIECES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = word_encoder(vocabulary)
        C.hold(word_encoder.cache_clear)
        end = np.array([END_ID], "<u4").tobytes()
        for batch in batches:
            rows = []
            for doc, ids in zip(batch.column("doc_id").to_pylist(), make.encode_all([t or "" for t in batch.column("text").to_pylist()])):
                ids += end
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    rows.append((doc, k, at // 4, len(part) // 4, zlib.crc32(part)))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(list(zip(*rows)) or [()] * 5, schema)], schema=schema)

    return docs.selectExpr("cast(doc_id AS long) AS doc_id", "cast(text AS string) AS text").mapInArrow(run, PIECES)


class Bins:
    """One solution: bins of pieces, and open bins by free space."""

    def __init__(self, capacity: int):
        self.capacity, self.items, self.fill = capacity, [], []
        self.by_room: dict[int, list[int]] = {}
        self.rooms = 0  # bit r: some bin has r free

    def _open(self, i: int) -> None:
        room = self.capacity - self.fill[i]
        if room:
            self.by_room.setdefault(room, []).append(i)
            self.rooms |= 1 << room

    def add(self, items: list[int], fill: int) -> None:
        self.items.append(items)
        self.fill.append(fill)
        self._open(len(self.items) - 1)

    def place(self, item: int, length: int) -> None:
        """Into the bin with the least room that is enough, or a new one."""
        above = self.rooms >> length
        if not above:
            self.add([item], length)
            return
        room = length + (above & -above).bit_length() - 1
        same = self.by_room[room]
        i = same.pop()
        if not same:
            self.rooms ^= 1 << room
        self.items[i].append(item)
        self.fill[i] += length
        self._open(i)

    def score(self) -> float:
        """Mean square of the fill: few bins, and full ones."""
        fill = np.array(self.fill) / self.capacity
        return float((fill * fill).mean()) if len(fill) else 1.0


def best_fit(order: np.ndarray, lengths: list[int], capacity: int) -> Bins:
    made = Bins(capacity)
    for i in order.tolist():
        made.place(i, lengths[i])
    return made


def crossover(base: Bins, injected: list[list[int]], lengths: list[int]) -> Bins:
    """A copy of ``base`` with the injected bins whole."""
    taken = {i for items in injected for i in items}
    made = Bins(base.capacity)
    for items in injected:
        made.add(list(items), sum(lengths[i] for i in items))
    displaced: list[int] = []
    for items, fill in zip(base.items, base.fill):
        if taken.isdisjoint(items):
            made.add(list(items), fill)
        else:
            displaced += [i for i in items if i not in taken]
    for i in sorted(displaced, key=lengths.__getitem__, reverse=True):
        made.place(i, lengths[i])
    return made


def realise(patterns: list[list[int]], lengths: list[int]) -> list[list[int]]:
    """Bins of own pieces with the lengths of foreign bins, as far as there are such pieces."""
    free: dict[int, list[int]] = {}
    for i, n in enumerate(lengths):
        free.setdefault(n, []).append(i)
    out = []
    for pattern in patterns:
        took = []
        for n in pattern:
            if not free.get(n):
                break
            took.append(free[n].pop())
        if len(took) == len(pattern):
            out.append(took)
        else:
            for i in took:
                free[lengths[i]].append(i)
    return out


def evolve(lengths: list[int], patterns: list[list[int]], capacity: int, seed: int, generations: int = GENERATIONS) -> Bins:
    """The best solution of one island."""
    rng = np.random.default_rng(seed)
    size = np.array(lengths, np.int64)
    people = [best_fit(np.argsort(-size, kind="stable"), lengths, capacity)]
    for _ in range(POPULATION - 1):  # nearly by size, so that parents differ
        people.append(best_fit(np.argsort(-size * rng.uniform(0.85, 1.0, len(size)), kind="stable"), lengths, capacity))
    foreign = realise(patterns, lengths)
    if foreign:
        people.append(crossover(people[0], foreign, lengths))
    scores = [p.score() for p in people]
    least = -(-int(size.sum()) // capacity)
    for _ in range(generations):
        if len(people[int(np.argmax(scores))].items) <= least:
            break
        a, b = (max(rng.integers(len(people), size=2), key=scores.__getitem__) for _ in range(2))
        donor = people[b]
        fill = np.array(donor.fill)
        good = np.flatnonzero(fill >= np.quantile(fill, 0.5))
        chosen = rng.permutation(good)[: max(1, len(good) // 4)]
        child = crossover(people[a], [donor.items[i] for i in chosen], lengths)
        worst = int(np.argmin(scores))
        if (score := child.score()) > scores[worst]:
            people[worst], scores[worst] = child, score
    return people[int(np.argmax(scores))]


def _island(turn: int, last: bool, capacity: int):
    """The work of one island in one round: its pieces with their places, and its elite."""
    names = [f.name for f in C.arrow_schema(PIECES)]

    def run(key, group):
        at_home = key[0].as_py()
        mine = group.filter(group.column("length").is_valid())
        patterns = group.filter(group.column("pattern").is_valid()).column("pattern").to_pylist()
        lengths = mine.column("length").to_pylist()
        n = len(lengths)
        best = evolve(lengths, patterns, capacity, (turn << 32) + at_home)
        sequence, offset, final = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, bool)
        for k, (items, fill) in enumerate(zip(best.items, best.fill)):
            at = 0
            for i in items:
                sequence[i], offset[i], final[i] = (turn << 56) + (at_home << 28) + k, at, last or fill >= FULL[turn - 1] * capacity
                at += lengths[i]
        rows = mine.select(names)
        more = {"sequence_id": pa.array(sequence), "offset": pa.array(offset), "final": pa.array(final),
                "island": pa.array(np.full(n, at_home, np.int32)), "pattern": pa.nulls(n, pa.list_(pa.int64()))}
        for name, column in more.items():
            rows = rows.append_column(name, column)
        top = sorted((k for k in range(len(best.items)) if len(best.items[k]) > 1), key=lambda k: -best.fill[k])[:ELITE]
        send = {c: pa.nulls(len(top), rows.schema.field(c).type) for c in rows.column_names}
        send |= {"island": pa.array([at_home + 1] * len(top), pa.int32()), "pattern": pa.array([[lengths[i] for i in best.items[k]] for k in top], pa.list_(pa.int64()))}
        return pa.concat_tables([rows, pa.table(send, schema=rows.schema)])

    return run


def pack_islands(pieces: DataFrame, store: Workspace, capacity: int = CAPACITY, island: int = ISLAND) -> DataFrame:
    """Pieces with sequence and offset. ``pieces`` has the columns of PIECES and was written."""
    whole = pieces.filter(F.col("length") == capacity).withColumns({"sequence_id": F.monotonically_increasing_id(), "offset": F.lit(0).cast("long")})
    left = pieces.filter(F.col("length") < capacity)
    names = [f.name for f in C.arrow_schema(PIECES)]
    elite: DataFrame | None = None
    done = [whole.select(*(x.strip().split()[0] for x in PACKED.split(",")))]
    for turn in range(1, len(FULL) + 1):
        n = left.count()
        if not n:
            break
        islands = -(-n // island)
        last = islands == 1 or turn == len(FULL)
        dealt = left.withColumn("island", (F.monotonically_increasing_id() % islands).cast("int")).withColumn("pattern", F.lit(None).cast("array<long>"))
        if elite is not None:
            guests = elite.select(*(F.lit(None).cast(k).alias(c) for c, k in (x.strip().split() for x in PIECES.split(","))), (F.col("island") % islands).cast("int").alias("island"), "pattern")
            dealt = dealt.unionByName(guests)

        made = store.keep(dealt.groupBy("island").applyInArrow(_island(turn, last, capacity), PACKED + ", final boolean, island int, pattern array<long>"), f"islands-{turn}")
        placed = made.filter("pattern IS NULL")
        done.append(placed.filter("final").select(done[0].columns))
        left = placed.filter("NOT final").select(*names)
        elite = made.filter("pattern IS NOT NULL").select("island", "pattern")
        if last:
            break
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return out


def pack_documents(docs: DataFrame, store: Workspace, vocabulary: str | None = None, capacity: int = CAPACITY, island: int = ISLAND) -> DataFrame:
    """All documents of (doc_id, text) packed."""
    return pack_islands(store.keep(cut_pieces(docs, vocabulary, capacity), "pieces"), store, capacity, island)


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of 4096 tokens."""
    return pack_documents(C.table(spark, sf_dir, "documents"), Workspace(spark))


QUERIES = {"op1_best_fit_packing": op1_best_fit_packing}
ORACLES: dict[str, str] = {}
