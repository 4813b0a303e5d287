import hashlib
import random
import zlib
from collections import defaultdict

import duckdb
import pytest

from taktline.llm import turn_trie
from taktline.workspace import Workspace

SCHEMA = "conv_id long, turn long, role string, text string"


def brute(rows):
    """Nodes by prefixes as tuples."""
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append((turn is not None, turn or 0, role or "", hashlib.md5((text or "").encode()).hexdigest(), text or ""))
    own = {c: [(r, t) for *_, r, _, t in sorted(v)] for c, v in own.items()}
    members, ends = defaultdict(set), defaultdict(list)
    for c in own:
        h = zlib.crc32(str(c).encode()) % 6
        base = c - int(abs(c) % 100) * (1 if c >= 0 else -1)
        seq = tuple(own.get(base, [])[:h] + own[c][h:])
        ends[seq].append(c)
        for d in range(len(seq) + 1):
            members[seq[:d]].add(c)
    children = defaultdict(list)
    for seq in members:
        if seq:
            children[seq[:-1]].append(seq)
    total = {}
    for seq in sorted(members, key=len, reverse=True):
        leaves = 0 if children[seq] else 1
        saved = (len(members[seq]) - 1) * len(seq[-1][1]) if seq else 0
        total[seq] = (leaves + sum(total[x][0] for x in children[seq]), saved + sum(total[x][1] for x in children[seq]))
    return sorted((
        min(m), len(seq), min(members[seq[:-1]]) if seq else None, len(m), len(children[seq]), *total[seq],
        hashlib.sha256(",".join(map(str, sorted(ends[seq]))).encode()).hexdigest()) for seq, m in members.items())


def run(spark, rows, schema=SCHEMA, **more):
    got = turn_trie.trie(spark.createDataFrame(rows, schema), Workspace(spark), **more).collect()
    return sorted((tuple(r) for r in got), key=lambda r: r[:2])


def made(seed):
    """Copies of long conversations, short ones, absent heads, negative ids."""
    rng, rows = random.Random(seed), []
    long = [(rng.choice(["user", "assistant"]), rng.choice(["x", "yy", "zzz"])) for _ in range(37)]
    for c in [*range(0, 12), 100, 103, 104, 205, 206, 207, -4, -204, 399]:
        seq = list(long[: rng.choice([1, 3, 8, 16, 17, 31, 32, 37])])
        if rng.random() < 0.3:
            seq[rng.randrange(len(seq))] = ("user", "other")
        rows += [(c, i * 400, r, t) for i, (r, t) in enumerate(seq)]
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_trie_equals_brute_force(spark, seed):
    rows = made(seed)
    assert run(spark, rows) == brute(rows)


def test_nulls_ties_repeated_rows_and_other_columns(spark):
    rows = [(5, None, "user", None), (5, 1, None, "a"), (5, 1, None, "a"), (5, 1, "user", "a"), (7, None, None, None), (None, 1, "user", "lost"),
            (300, 0, "user", "h"), (301, 0, "user", "h"), (301, 9, "user", ""), (302, 0, "system", "é漢"), (8, 2, "user", "x" * 100_000)]
    wide = [(*r, 1, "s", 2) for r in rows]
    assert run(spark, wide, SCHEMA + ", a long, name string, pos long") == brute(rows)


def test_empty_table(spark):
    assert run(spark, []) == []


def test_one_conversation_without_turn_numbers_and_lists_in_pieces(spark):
    rows = [(1, None, "user", str(i)) for i in range(150)] + [(1000 + i, 0, "user", "same") for i in range(0, 4000, 100)]
    assert run(spark, rows, piece=3) == brute(rows)


def test_sql_states_the_same(spark):
    rows = made(3) + [(6, None, None, None)]
    con = duckdb.connect()
    con.sql("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    con.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", rows)
    assert sorted(con.execute(turn_trie.SQL).fetchall()) == brute(rows)
