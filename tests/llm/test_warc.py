"""WARC: a round trip of any text, revisits, nested captures, broken archives."""

import gzip
import hashlib
from pathlib import Path

import pytest

from taktline.llm import chunks, warc
from taktline.workspace import Workspace

SCHEMA = "page_id long, url string, html string, kind string"


def trip(spark, rows, payloads=True):
    df = chunks.prepare(spark).createDataFrame([(*r, "x") for r in rows], SCHEMA).repartition(3)
    path = f"{Workspace(spark).folder}/archives"
    warc.write_archives(df, path)
    return warc.captures(warc.read_records(spark, path, payloads)), path


def expected(rows):
    out, top = [], {}
    for page, _, text in rows:
        raw = (text or "").encode()
        if len(raw) >= 1000 and page is not None:
            top[raw] = max(page, top.get(raw, page))
    for page, _, text in rows:
        raw = (text or "").encode()
        again = raw in top and top[raw] != page
        out.append((page, len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if again else "response", top[raw] if again else None))
    return out


def key(row):
    return tuple((x is None, x or 0) for x in row)


ROWS = [
    (1, "http://a/ b\r\nX: y", "short"), (2, "http://b", "short"), (3, "http://c", "é" * 600), (4, "http://d", "é" * 600), (5, None, "é" * 600), (6, "", None), (7, "u", ""),
    (8, "http://e", "\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\n\r\n" * 40), (9, "http://f", "x" * 300_000), (4, "http://d", "é" * 600), (2, "http://b", "short"), (10, "u", "\u0000  end"), (None, "n", "é" * 600),
]


def test_round_trip(spark):
    found, path = trip(spark, ROWS)
    got = sorted((tuple(r) for r in warc.resolved(found).collect()), key=key)
    assert got == sorted(expected(ROWS), key=key)
    full = found.filter("main.kind = 'response'").select("metadata.page_id", "metadata.url", "main.payload", "request.kind").collect()
    texts = {(p, u, (t or "")) for p, u, t in ROWS}
    assert all((r.page_id, r.url, bytes(r.payload).decode()) in texts and r.kind == "request" for r in full)
    files = [p for p in Path(path.removeprefix("file:")).iterdir() if p.name.startswith("part")]
    assert files and all(gzip.decompress(p.read_bytes())[:8] in (b"WARC/1.1", b"") for p in files)


def test_null_ids_only(spark):
    rows = [(None, "u", "z" * 1200), (None, "v", "z" * 1200)]
    found, _ = trip(spark, rows)
    assert sorted(r.record_type for r in warc.resolved(found).collect()) == ["response", "response"]


def test_empty(spark):
    found, _ = trip(spark, [])
    assert warc.resolved(found).count() == 0


def test_broken_archive_is_an_error():
    with pytest.raises(ValueError):
        list(warc.parse(b"WARC/1.1\r\nContent-Length: 10\r\n\r\nabc"))
    with pytest.raises(ValueError):
        list(warc.parse(b"no archive at all"))
