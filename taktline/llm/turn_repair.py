"""Structure repair of conversations: faults per turn, cheapest edits to ``(s?(ua)+)?``, repaired text.

Turns are numbered per conversation and cut in segments of ``SEGMENT`` turns, so that a conversation with a third of all
turns is many small groups. A segment's task searches the cheapest edits between each role state at its start and each
at its end (``lattice.cheapest``, bidirectional Dijkstra). These at most 16 ways per segment are composed, pair by pair,
to the ways of the conversation; what the best one does in a segment is carried out by the segment's own task again, and
the text of the segments is hashed one after the other. No task holds more text than a segment has; the task that composes
the ways of a conversation holds their audits, of which one is a cell of the result anyway.

Faults, the first one counts: blank (no character but white space), duplicate (role and text stand in an earlier turn),
truncated (the last character that is no white space is none of ``.!?``). Blank and duplicate turns have to go.

Defined cases: a null role or text is one blank, so is a null in the key of the damage; null turns come first; turns with
the same number are ordered by role and md5 of the text; rows without conv_id are one conversation; equal rows are
duplicates; conversations without rows after the damage have zeros, an empty audit and the hash of nothing; an empty
table gives no rows; other columns don't matter.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from taktline.llm import chunks as C
from taktline.llm import lattice as L
from taktline.llm.turn_trie import BLOCK, CRC32
from taktline.operators.ordering import running_number
from taktline.workspace import Workspace

SEGMENT = 512
SPACE = " \t\n\x0b\x0c\r"
BLANK, DUPLICATE, TRUNCATED = 1, 2, 3
LEGAL = ("su", "ua", "au")
WAYS = "conv string, segment long, initials string, entry array<long>, exit array<long>, cost array<long>, audit array<string>"
CHOICES = "conv string, segment long, entry long, piece string, illegal long, cost long, audit string"
TEXTS = "conv string, segment long, piece binary"
HASHES = "conv string, repaired_sha256 string"
_KINDS = {"array<string>": pa.list_(pa.string())}


def _arrow(ddl: str) -> pa.Schema:
    fields = [x.split(" ", 1) for x in ddl.split(", ")]
    return pa.schema([(n, _KINDS[k]) if k in _KINDS else (n, C.arrow_schema(f"{n} {k}").field(0).type) for n, k in fields])


def plain(rows: DataFrame) -> DataFrame:
    """(conv, turn, role, text) of rows (conv_id, turn, role, text); conv is the id as text, empty for null."""
    text = lambda c, other: F.coalesce(F.col(c).cast("string"), F.lit(other)).alias(c)
    return rows.select(text("conv_id", "").alias("conv"), F.col("turn").cast("long").alias("turn"), text("role", " "), text("text", " "))


def damaged(turns: DataFrame) -> DataFrame:
    """Turns with the faults that the crc32 of ``conv:turn`` decides on."""
    key = F.concat(F.when(F.col("conv") == "", " ").otherwise(F.col("conv")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    kind = F.crc32(key.cast("binary")) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    copies = F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1)
    return turns.select("conv", "turn", F.when(kind == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.explode(F.array_repeat(F.lit(0), copies)).alias("_")).drop("_")


def numbered(turns: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """Turns with their place (pos from 0), segment and what a turn alone shows."""
    turns = turns.withColumn("digest", F.md5("text"))
    block = F.struct(F.floor(F.col("turn") / BLOCK).alias("t"), F.when(F.col("turn").isNull(), F.struct("role", F.substring("digest", 1, 2))).alias("r"))
    out = running_number(turns, ["conv"], [F.col("turn").asc_nulls_first(), F.col("role"), F.col("digest")], block, "pos")
    bare = F.rtrim(F.col("text"), F.lit(SPACE))
    alone = F.when(bare == "", BLANK).when(~F.substring(bare, -1, 1).isin(".", "!", "?"), TRUNCATED).otherwise(0)
    return out.withColumns({"pos": (F.col("pos") - 1).cast("long"), "segment": F.floor((F.col("pos") - 1) / segment).cast("long"), "alone": alone})


def faults(turns: DataFrame) -> DataFrame:
    """(conv, segment, pos, turn, initial, fault) of numbered turns."""
    first = turns.groupBy("conv", "role", "digest").agg(F.min("pos").alias("_first"), F.count(F.lit(1)).alias("_n")).filter("_n > 1").drop("_n")
    marked = turns.select("conv", "segment", "pos", "turn", "role", "digest", "alone").join(first, ["conv", "role", "digest"], "left")
    fault = F.when(F.col("alone") == BLANK, BLANK).when(F.col("pos") > F.col("_first"), DUPLICATE).otherwise(F.col("alone"))
    initial = F.when(F.col("role") == "", " ").otherwise(F.substring("role", 1, 1))
    return marked.select("conv", "segment", "pos", "turn", initial.alias("initial"), fault.alias("fault"))


def ways(found: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """Per segment the cheapest edits between role states at its two ends."""

    def search(group: pa.Table) -> pa.Table:
        group = group.sort_by("pos")
        initials = group.column("initial").to_pylist()
        turns = [(i, f in (BLANK, DUPLICATE), f == TRUNCATED) for i, f in zip(initials, group.column("fault").to_pylist())]
        number = group.column("segment")[0].as_py()
        entries = [L.START] if number == 0 else L.STATES
        # A first segment that is not full is the whole conversation.
        exits = [[x] for x in L.STATES] if number or len(turns) == segment else [L.FINAL]
        made = [(e, x[0], way) for e in entries for x in exits if (way := L.cheapest(turns, e, x))]
        return pa.Table.from_pylist([{
            "conv": group.column("conv")[0].as_py(), "segment": number, "initials": "".join(initials), "entry": [e for e, _, _ in made],
            "exit": [x for _, x, _ in made], "cost": [w[0] for *_, w in made], "audit": [w[1] for *_, w in made]}], _arrow(WAYS))

    return found.select("conv", "segment", "pos", "initial", "fault").groupBy("conv", "segment").applyInArrow(search, WAYS)


Ways = dict[tuple[int, int], L.Label]


def composed(parts: list[Ways]) -> Ways:
    """Ways through neighbouring segments, joined pair by pair, so that an audit is copied only log2(segments) times."""
    while len(parts) > 1:
        joined = []
        for left, right in zip(parts[::2], parts[1::2]):
            both: Ways = {}
            for (entry, middle), (cost, audit) in left.items():
                for (start, end), (more, rest) in right.items():
                    if start == middle:
                        label = cost + more, audit + rest
                        if (entry, end) not in both or label < both[entry, end]:
                            both[entry, end] = label
            joined.append(both)
        parts = joined + parts[len(parts) - len(parts) % 2 :]
    return parts[0]


def cut_audit(audit: str, initials: list[str]) -> list[tuple[int, str]]:
    """State and edits of each segment; inserts between two segments belong to the later one."""
    out, at, state = [], 0, L.START
    for i, chars in enumerate(initials):
        start, entry, used = at, state, 0
        while used < len(chars) or (i == len(initials) - 1 and at < len(audit)):
            edit = audit[at]
            if edit == L.KEEP:
                state = L.KEPT[chars[used]]
            elif edit != L.DELETE:
                state = L.NEXT[state]
            used += edit != L.INSERT
            at += 1
        out.append((entry, audit[start:at]))
    return out


def choices(segments: DataFrame) -> DataFrame:
    """Edits of each segment; in the row of the first one cost, audit and illegal neighbours of the conversation."""

    def choose(group: pa.Table) -> pa.Table:
        rows = group.sort_by("segment").to_pylist()
        whole = composed([{(e, x): (c, a) for e, x, c, a in zip(r["entry"], r["exit"], r["cost"], r["audit"])} for r in rows])
        cost, audit = min(label for (entry, end), label in whole.items() if entry == L.START and end in L.FINAL)
        initials = "".join(r["initials"] for r in rows)
        illegal = sum(initials[i : i + 2] not in LEGAL for i in range(len(initials) - 1))
        told = [{"conv": r["conv"], "segment": r["segment"], "entry": e, "piece": p} for r, (e, p) in zip(rows, cut_audit(audit, [r["initials"] for r in rows]))]
        told[0] |= {"illegal": illegal, "cost": cost, "audit": audit}
        return pa.Table.from_pylist(told, _arrow(CHOICES))

    return segments.groupBy("conv").applyInArrow(choose, CHOICES)


def repaired(turns: DataFrame, chosen: DataFrame) -> DataFrame:
    """Text of each segment after its edits: ``role:text`` lines, null without any."""

    def carry_out(left: pa.Table, right: pa.Table) -> pa.Table:
        left = left.sort_by("pos")
        edits = right.to_pylist()[0]
        kept, _ = L.apply(list(zip(left.column("role").to_pylist(), left.column("text").to_pylist())), edits["piece"], edits["entry"])
        piece = "\n".join(f"{role}:{text}" for role, text in kept).encode() if kept else None
        return pa.Table.from_pylist([{"conv": edits["conv"], "segment": edits["segment"], "piece": piece}], _arrow(TEXTS))

    rows = turns.select("conv", "segment", "pos", "role", "text").groupBy("conv", "segment")
    return rows.cogroup(chosen.select("conv", "segment", "entry", "piece").groupBy("conv", "segment")).applyInArrow(carry_out, TEXTS)


def text_hashes(pieces: DataFrame) -> DataFrame:
    """SHA-256 of the segments of each conversation, joined by newlines and fed one by one."""

    def feed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, state = None, None

        def told(found: list[tuple[str, str]]) -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist([{"conv": c, "repaired_sha256": h} for c, h in found], _arrow(HASHES))

        for batch in batches:
            done = []
            for name, piece in zip(batch.column("conv").to_pylist(), batch.column("piece")):
                if state is None or name != conv:
                    if state is not None:
                        done.append((conv, state.hexdigest()))
                    conv, state = name, hashlib.sha256(piece.as_buffer())
                else:
                    state.update(b"\n")
                    state.update(piece.as_buffer())
            yield told(done)
        if state is not None:
            yield told([(conv, state.hexdigest())])

    return pieces.filter("piece IS NOT NULL").repartition("conv").sortWithinPartitions("conv", "segment").select("conv", "piece").mapInArrow(feed, HASHES)


def repair(turns: DataFrame, store: Workspace, segment: int = SEGMENT) -> tuple[DataFrame, DataFrame]:
    """Of plain turns: one row per conversation with faults and edits, and the repaired text per segment."""
    turns = store.keep(numbered(turns, segment), "turns")
    found = store.keep(faults(turns), "faults")
    chosen = store.keep(choices(ways(found, segment)), "choices")
    pieces = repaired(turns, chosen)
    numbers = found.groupBy("conv", "turn").agg(*(F.sum((F.col("fault") == k).cast("long")).alias(n) for n, k in (("blank", BLANK), ("duplicate", DUPLICATE), ("truncated", TRUNCATED))))
    stats = numbers.groupBy("conv").agg(
        F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0)).cast("long").alias("gaps"), *(F.sum(n).alias(n) for n in ("blank", "duplicate", "truncated")))
    return stats.join(chosen.filter("segment = 0").select("conv", "illegal", "cost", "audit"), "conv"), pieces


def op11_structure_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, damaged and repaired."""
    turns = plain(C.table(spark, sf_dir, "conversations"))
    return damage_and_repair(turns, Workspace(spark))


def damage_and_repair(turns: DataFrame, store: Workspace, segment: int = SEGMENT) -> DataFrame:
    told, pieces = repair(damaged(turns), store, segment)
    out = turns.select("conv").distinct().join(told, "conv", "left").join(text_hashes(pieces), "conv", "left")
    none: dict[str, Column] = {c: F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")}
    return out.select(
        F.when(F.col("conv") != "", F.col("conv")).cast("long").alias("conv_id"), *none.values(), F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"))


def _sql_labels(initial: str, fault: str, old: str) -> str:
    """SQL list of the four labels after a turn; ``old``: the list before."""
    def label(state: int, cost: str, edit: str) -> str:
        return f"{{'c': {old}[{state + 1}].c + {cost}, 'a': {old}[{state + 1}].a || '{edit}'}}"

    far, keep, change = 10**9, f"CASE WHEN {fault} = 3 THEN 3 ELSE 0 END", f"CASE WHEN {fault} = 3 THEN 6 ELSE 3 END"
    when = lambda to, s: f"CASE WHEN {fault} IN (1, 2) OR {initial} <> '{to}' THEN {far} ELSE {keep} END"
    moved = f"CASE WHEN {fault} IN (1, 2) THEN {far} ELSE {change} END"
    least = lambda *xs: f"list_min([{', '.join(xs)}])"
    gone = [label(s, "4", "D") for s in range(4)]
    before_user = (L.START, L.SYSTEM, L.ASSISTANT)
    return "[" + ", ".join([
        gone[L.START], least(gone[L.SYSTEM], label(L.START, when("s", 0), "K")),
        least(gone[L.USER], *(label(s, when("u", s), "K") for s in before_user), *(label(s, moved, "R") for s in before_user)),
        least(gone[L.ASSISTANT], label(L.USER, when("a", L.USER), "K"), label(L.USER, moved, "R"))]) + "]"


def _sql_inserts(old: str) -> str:
    """SQL list of the labels after one insert or none."""
    label = lambda s: f"{{'c': {old}[{s + 1}].c + 3, 'a': {old}[{s + 1}].a || 'I'}}"
    return f"[{old}[1], {old}[2], list_min([{old}[3], {label(0)}, {label(1)}, {label(3)}]), list_min([{old}[4], {label(2)}])]"


_FAR = "{'c': 1000000000::BIGINT, 'a': ''}"
_WHITE = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_KEY = "coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')"
SQL = f"""
WITH RECURSIVE o AS (
  SELECT coalesce(CAST(conv_id AS VARCHAR), '') AS conv, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {CRC32.format(_KEY)} % 20 AS kind
  FROM conversations),
d AS (
  SELECT conv, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
    CASE WHEN kind = 1 THEN '' WHEN kind = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM o, unnest(range(CASE WHEN kind = 0 THEN 0 WHEN kind = 3 THEN 2 ELSE 1 END)) WHERE kind <> 0),
p AS (SELECT *, row_number() OVER (PARTITION BY conv ORDER BY turn NULLS FIRST, role, md5(text)) AS pos, rtrim(text, {_WHITE}) AS bare FROM d),
q AS (
  SELECT *, CASE WHEN bare = '' THEN 1 WHEN row_number() OVER (PARTITION BY conv, role, text ORDER BY pos) > 1 THEN 2
    WHEN right(bare, 1) NOT IN ('.', '!', '?') THEN 3 ELSE 0 END AS fault,
    CASE WHEN role = '' THEN ' ' ELSE left(role, 1) END AS initial FROM p),
w AS (SELECT *, lag(initial) OVER (PARTITION BY conv ORDER BY pos) || initial AS pair FROM q),
c AS (
  SELECT conv, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps, count(*) FILTER (fault = 1) AS blank, count(*) FILTER (fault = 2) AS duplicate,
    count(*) FILTER (fault = 3) AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n, list(role ORDER BY pos) AS roles, list(text ORDER BY pos) AS texts
  FROM w GROUP BY conv),
s AS (
  SELECT conv, 0::BIGINT AS pos, [{{'c': 0::BIGINT, 'a': ''}}, {_FAR}, {{'c': 3::BIGINT, 'a': 'I'}}, {{'c': 6::BIGINT, 'a': 'II'}}] AS f FROM c
  UNION ALL
  SELECT conv, pos, {_sql_inserts("f")} AS f FROM (SELECT conv, pos, {_sql_inserts("f")} AS f FROM (
    SELECT s.conv, w.pos, {_sql_labels("w.initial", "w.fault", "s.f")} AS f FROM s JOIN w ON w.conv = s.conv AND w.pos = s.pos + 1))),
b AS (SELECT c.*, list_min([s.f[1], s.f[4]]) AS best FROM c JOIN s ON s.conv = c.conv AND s.pos = c.n),
r AS (
  SELECT conv, 0 AS k, 0 AS i, 0 AS state, []::VARCHAR[] AS kept FROM b
  UNION ALL
  SELECT conv, k + 1, CASE WHEN e = 'I' THEN i ELSE i + 1 END,
    CASE WHEN e = 'D' THEN state WHEN e = 'K' THEN CASE left(role, 1) WHEN 's' THEN 1 WHEN 'u' THEN 2 ELSE 3 END WHEN state = 2 THEN 3 ELSE 2 END,
    CASE e WHEN 'D' THEN kept WHEN 'K' THEN list_append(kept, role || ':' || text) WHEN 'R' THEN list_append(kept, new || text) ELSE list_append(kept, new) END
  FROM (
    SELECT r.*, b.best.a[k + 1] AS e, b.roles[i + 1] AS role, b.texts[i + 1] AS text, CASE WHEN state = 2 THEN 'assistant:' ELSE 'user:' END AS new
    FROM r JOIN b USING (conv) WHERE k < length(b.best.a)))
SELECT CAST(nullif(a.conv, '') AS BIGINT) AS conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
  coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(b.best.c, 0) AS cost, coalesce(b.best.a, '') AS audit,
  sha256(coalesce(array_to_string(r.kept, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv FROM o) a LEFT JOIN b USING (conv) LEFT JOIN r ON r.conv = b.conv AND r.k = length(b.best.a)
"""

QUERIES = {"op11_structure_repair": op11_structure_repair}
ORACLES = {"op11_structure_repair": SQL}
