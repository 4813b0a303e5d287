import hashlib
import random
import re
import zlib
from collections import defaultdict

import duckdb
import pytest

from taktline.llm import lattice as L
from taktline.llm import turn_repair
from taktline.workspace import Workspace

SCHEMA = "conv_id long, turn long, role string, text string"
FAR = (10**9, "")


def by_suffixes(turns, entry=L.START, exits=L.FINAL):
    """Least cost and audit by dynamic programming from the end."""
    def inserts(labels):
        for _ in range(4):
            labels = {s: min(labels[s], (labels[L.NEXT[s]][0] + 3, "I" + labels[L.NEXT[s]][1])) for s in L.STATES}
        return labels

    labels = inserts({s: (0, "") if s in exits else FAR for s in L.STATES})
    for initial, gone, truncated in reversed(turns):
        new = {}
        for s in L.STATES:
            ways = [(4 + labels[s][0], "D" + labels[s][1])]
            if not gone:
                after = labels[L.NEXT[s]]
                ways.append((3 + 3 * truncated + after[0], "R" + after[1]))
                fits = {"s": s == L.START, "u": s != L.USER, "a": s == L.USER}.get(initial, False)
                if fits:
                    after = labels["?sua".index(initial)]
                    ways.append((3 * truncated + after[0], "K" + after[1]))
            new[s] = min(ways)
        labels = inserts(new)
    return labels[entry] if labels[entry][0] < 10**9 else None


def brute(rows):
    """Whole result of rows (conv_id, turn, role, text)."""
    text = lambda x: " " if x is None else str(x)
    convs = defaultdict(list)
    for conv, turn, role, said in rows:
        kind = zlib.crc32(f"{text(conv)}:{text(turn)}".encode()) % 20
        role, said = text(role), text(said)
        said = "" if kind == 1 else re.sub("[.!?]", "", said) if kind == 2 else said
        role = "user" if kind == 4 else role
        convs[conv] += [(turn is not None, turn or 0, role, hashlib.md5(said.encode()).hexdigest(), said)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    out = []
    for conv, found in convs.items():
        found.sort()
        seen, turns, counts = set(), [], [0, 0, 0]
        for _, _, role, _, said in found:
            bare = said.rstrip(" \t\n\v\f\r")
            fault = 0 if not bare else 1 if (role, said) in seen else 2 if bare[-1] not in ".!?" else None
            seen.add((role, said))
            if fault is not None:
                counts[fault] += 1
            turns.append((role[:1] or " ", fault in (0, 1), fault == 2))
        numbers = [t for known, t, *_ in found if known]
        gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
        illegal = sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in zip(turns, turns[1:]))
        cost, audit = by_suffixes(turns) if turns else (0, "")
        kept, at = [], iter(found)
        for edit in audit:
            role = "assistant" if kept and kept[-1][0][:1] == "u" else "user"
            if edit == "I":
                kept.append((role, ""))
            else:
                _, _, own, _, said = next(at)
                kept += [] if edit == "D" else [(own if edit == "K" else role, said)]
        digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in kept).encode()).hexdigest()
        out.append((conv, gaps, *counts, illegal, cost, audit, digest))
    return sorted(out, key=lambda r: (r[0] is not None, r[0]))


def run(spark, rows, schema=SCHEMA, segment=turn_repair.SEGMENT):
    turns = turn_repair.plain(spark.createDataFrame(rows, schema))
    got = turn_repair.damage_and_repair(turns, Workspace(spark), segment).collect()
    return sorted((tuple(r) for r in got), key=lambda r: (r[0] is not None, r[0]))


def made(seed, convs=40):
    rng, rows = random.Random(seed), []
    for c in range(convs):
        for i in range(rng.choice([1, 2, 4, 7, 12, 23])):
            rows.append((c, i + rng.choice([0, 0, 0, 1, 5]), rng.choice(["user", "assistant", "system", "tool", "U", ""]), rng.choice(["Yes.", "No", " ", "Why?\n", "a b!", ""])))
    return rows


def test_search_finds_the_least_audit_of_the_least_cost():
    rng = random.Random(1)
    for _ in range(6000):
        turns = [(rng.choice("suuaax "), rng.random() < 0.25, rng.random() < 0.3) for _ in range(rng.randrange(9))]
        entry, exits = rng.choice(L.STATES), rng.choice([L.FINAL, L.FINAL, (0,), (1,), (2,), (3,)])
        assert L.cheapest(turns, entry, exits) == by_suffixes(turns, entry, exits), (turns, entry, exits)


def test_both_directions_settle_fewer_nodes_than_one(monkeypatch):
    settled = []
    monkeypatch.setattr(L._Side, "settle", lambda self, old=L._Side.settle: settled.append(old(self)) or settled[-1])
    assert L.cheapest([("u", False, False), ("a", False, False)] * 300) == (0, "K" * 600)
    assert len(settled) < 1300


@pytest.mark.parametrize("segment", [1, 4, 512])
def test_repair_equals_brute_force(spark, segment):
    rows = made(segment)
    assert run(spark, rows, segment=segment) == brute(rows)


def test_nulls_long_texts_and_other_columns(spark):
    rows = [(None, 1, "user", "a."), (None, None, None, None), (3, None, None, "x."), (3, None, "user", None), (4, 0, "user", "long " * 200_000), (4, 1, "assistant", "é漢."),
            (5, 7, "user", "A."), (5, 7, "user", "A."), (5, 7, "assistant", "B.")]
    wide = [(*r, 1, "s", "x", 0) for r in rows]
    assert run(spark, wide, SCHEMA + ", pos long, conv string, segment string, fault int") == brute(rows)


def test_empty_table_and_conversations_without_rows(spark):
    assert run(spark, []) == []
    dropped = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    rows = [(dropped, 0, "user", "gone.")]
    assert run(spark, rows) == brute(rows) == [(dropped, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]


def test_sql_states_the_same():
    rows = made(7) + [(None, None, None, None), (99, 3, "user", "a\n")]
    con = duckdb.connect()
    con.sql("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    con.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", rows)
    got = sorted(con.execute(turn_repair.SQL).fetchall(), key=lambda r: (r[0] is not None, r[0]))
    assert got == brute(rows)
