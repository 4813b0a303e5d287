"""Quality rules, line first.

Each line that has a word is held against three kinds of rules:

* punctuation: more than a tenth of its characters are symbols of ``#*$%&|<>``; or it has an exclamation mark per word
  and three at least; or it has 60 words and no sentence mark; or it has one or two words and no sentence mark at all;
* navigation: two stand-alone separators at least, one per three words;
* boilerplate: at most 30 words with a phrase of the fixed list below.

Lines that fail are removed. A document is rejected if it fails the base rules, if more than ``MAX_LOST`` percent of its
word characters stood in lines that failed, or if nothing is left. The first line with a licence or copyright phrase
(``LICENCE``) and no other boilerplate does not count in that share, so that a short text under a licence stays; a second
such line counts.

Defined cases: a null or empty text has no words, fails the base (fewer than 10 words) and is not kept; a null doc_id is
passed on; equal rows are judged alike, each on its own; other columns don't matter.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from taktline.llm import chunks as C
from taktline.llm.words import run_hashes, word_hashes

MIN_WORDS = 10
WINDOW = 5
MAX_REPEAT = 20  # percent of words in repeated windows
MAX_LOST = 50  # percent of word characters in removed lines
SYMBOLS = "#*$%&|<>"
# Phrases of boilerplate lines, lower case.
BOILERPLATE = (
    "all rights reserved", "licensed under", "released under", "terms of use", "terms of service", "privacy policy",
    "cookie policy", "uses cookies", "use cookies", "enable javascript", "javascript is disabled", "lorem ipsum",
    "click here", "sign up for", "subscribe to our", "log in to", "back to top", "share this", "skip to content",
)
LICENCE = BOILERPLATE[:3]
# Separators of navigation lines.
SEPARATORS = ("|", "»", "›", "•", "·", ">", "::")
_PHRASES = re.compile("|".join(map(re.escape, BOILERPLATE)))
_WEB = re.compile("|".join(map(re.escape, BOILERPLATE[len(LICENCE) :])))
_SYMBOLS = re.compile("[#*$%&|<>]")
_SEPARATORS = frozenset(x.encode() for x in SEPARATORS)
_SENTENCE = re.compile("[.!?…。！？]")
_MARKS = re.compile("[.!?…。！？:;：；]")
_UPPER = bytes(range(65, 91))


def line_fails(line: bytes) -> bool:
    """Verdict on a line with a word."""
    return bad_marks(line) or boilerplate(line)


def boilerplate(line: bytes) -> bool:
    return len(line.split()) <= 30 and _PHRASES.search(line.lower().decode()) is not None


def bad_marks(line: bytes) -> bool:
    """Whether a line fails for punctuation or navigation."""
    words = line.split()
    n = len(words)
    text = line.decode()
    symbols = sum(line.count(c) for c in b"#*$%&|<>")
    if symbols:
        if 10 * symbols > len(b"".join(words).decode()):
            return True
    marks = line.count(b"!")
    if marks >= 3 and marks >= n:
        return True
    if n >= 60 and not _SENTENCE.search(text) or n <= 2 and not _MARKS.search(text):
        return True
    separators = sum(w in _SEPARATORS for w in words)
    return separators >= 2 and 3 * separators >= n


def repeat_words(words: list[bytes]) -> int:
    """Words that stand in a 5-word window found twice or more in the text."""
    if len(words) <= WINDOW:
        return 0
    windows = run_hashes(word_hashes(words), WINDOW)
    _, inverse, counts = np.unique(windows, return_inverse=True, return_counts=True)
    if counts.max() < 2:
        return 0
    edge = np.zeros(len(words) + 1, np.int64)
    again = np.flatnonzero(counts[inverse] > 1)
    np.add.at(edge, again, 1)
    np.add.at(edge, again + WINDOW, -1)
    return int((np.cumsum(edge) > 0).sum())


def judge(text: bytes) -> tuple:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, n_lines_removed, lost_chars, cleaned."""
    words = text.split()
    n = len(words)
    chars = len(b"".join(words).decode())
    symbols = len(_SYMBOLS.findall(text.decode()))
    lines = text.split(b"\n")
    seen: set[bytes] = set()
    keep, dup, lost, stock = [], 0, 0, 0
    for line in lines:
        own = line.split()
        if not own:
            keep.append(True)
            continue
        dup += line in seen
        seen.add(line)
        if bad_marks(line):
            lost += len(b"".join(own).decode())
            keep.append(False)
        elif boilerplate(line):
            size = len(b"".join(own).decode())
            if stock or _WEB.search(line.lower().decode()):
                lost += size
            else:
                stock += size
            keep.append(False)
        else:
            keep.append(True)
    repeats = repeat_words(words)
    base = n < MIN_WORDS or 100 * repeats > MAX_REPEAT * n
    kept = not base and 100 * lost <= MAX_LOST * (chars - stock) and chars > stock
    removed = len(keep) - sum(keep)
    return n, chars, symbols, dup, repeats, base, kept, removed, lost + stock, b"\n".join(compress(lines, keep)) if removed else text


FIELDS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_lines_removed", "lost_chars")
REPORT = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, n_lines_removed long, lost_chars long"


def quality_report(docs: DataFrame) -> DataFrame:
    """One row of counts and verdicts per document row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = list(zip(*(judge(t)[:-1] for t in C.texts_of(pa.Table.from_batches([batch]))))) or [[]] * len(FIELDS)
            kinds = [pa.bool_() if f in ("base_failed", "kept") else pa.int64() for f in FIELDS]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), *(pa.array(list(x), k) for x, k in zip(found, kinds))], names=["doc_id", *FIELDS])

    return docs.select("doc_id", "text").mapInArrow(run, REPORT)


def keep_good(docs: DataFrame) -> DataFrame:
    """Kept documents with all their columns; ``text`` without failing lines, ``n_chars`` to match where it is there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        C.trim()
        for batch in batches:
            verdicts = [judge(t) for t in C.texts_of(pa.Table.from_batches([batch]))]
            rows = with_text(pa.Table.from_batches([batch]), [v[-1] for v in verdicts])
            yield from rows.filter(pa.array([v[6] for v in verdicts], pa.bool_())).to_batches()

    return docs.mapInArrow(run, docs.schema)


def with_text(rows: pa.Table, texts: list[bytes]) -> pa.Table:
    """Rows with other texts, and their number of code points in ``n_chars`` if there is such a column."""
    names = rows.column_names
    new = pa.array([t.decode() for t in texts], pa.string())
    rows = rows.set_column(names.index("text"), "text", new.cast(rows.schema.field("text").type))
    if "n_chars" in names:
        kind = rows.schema.field("n_chars").type
        rows = rows.set_column(names.index("n_chars"), "n_chars", pa.array([len(t.decode()) for t in texts], pa.int64()).cast(kind))
    return rows


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdicts over all documents."""
    return quality_report(C.table(spark, sf_dir, "documents"))


_WS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_PHRASE_SQL, _WEB_SQL = "|".join(BOILERPLATE), "|".join(BOILERPLATE[len(LICENCE) :])
SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws FROM d),
runs AS (
  SELECT r, i, array_to_string(ws[i:i+4], ' ') AS run
  FROM (SELECT r, ws, unnest(range(1, len(ws) - 3)) AS i FROM w)),
again AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, run) AS n FROM runs) WHERE n > 1),
covered AS (SELECT r, count(DISTINCT i + j) AS n_repeat_words FROM again, range(0, 5) AS x(j) GROUP BY r),
split AS (
  SELECT r, unnest(string_split(t, chr(10))) AS line, generate_subscripts(string_split(t, chr(10)), 1) AS i FROM d),
l AS (
  SELECT r, i, line, regexp_extract_all(line, '[^\x20\x09-\x0D]+') AS lw FROM split),
lines AS (
  SELECT r, i, line, len(lw) AS n, length(array_to_string(lw, '')) AS chars,
    length(line) - length(regexp_replace(line, '[#*$%&|<>]', '', 'g')) AS symbols,
    length(line) - length(replace(line, '!', '')) AS marks,
    len(list_filter(lw, lambda x: x IN ({", ".join(repr(x) for x in SEPARATORS)}))) AS seps,
    regexp_matches(line, '[.!?…。！？]') AS sentence, regexp_matches(line, '[.!?…。！？:;：；]') AS mark,
    regexp_matches(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_PHRASE_SQL}') AS phrase,
    regexp_matches(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_WEB_SQL}') AS web,
    row_number() OVER (PARTITION BY r, line ORDER BY i) AS copy
  FROM l WHERE len(lw) > 0),
judged AS (
  SELECT *, 10 * symbols > chars OR (marks >= 3 AND marks >= n) OR (n >= 60 AND NOT sentence) OR (n <= 2 AND NOT mark)
    OR (seps >= 2 AND 3 * seps >= n) AS bad, NOT bad AND n <= 30 AND phrase AND NOT web AS licence,
    licence AND i = min(CASE WHEN licence THEN i END) OVER (PARTITION BY r) AS stock,
    bad OR (n <= 30 AND phrase) AS fails
  FROM lines),
per AS (
  SELECT r, sum(chars)::BIGINT AS word_chars, count_if(copy > 1)::BIGINT AS n_dup_lines,
    count_if(fails)::BIGINT AS n_lines_removed, sum(CASE WHEN fails THEN chars ELSE 0 END)::BIGINT AS lost_chars,
    sum(CASE WHEN stock THEN chars ELSE 0 END)::BIGINT AS stock_chars
  FROM judged GROUP BY r),
c AS (
  SELECT w.doc_id, len(w.ws)::BIGINT AS n_words, coalesce(p.word_chars, 0)::BIGINT AS word_chars,
    (length(w.t) - length(regexp_replace(w.t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
    coalesce(p.n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(v.n_repeat_words, 0)::BIGINT AS n_repeat_words,
    coalesce(p.n_lines_removed, 0)::BIGINT AS n_lines_removed, coalesce(p.lost_chars, 0)::BIGINT AS lost_chars,
    coalesce(p.stock_chars, 0)::BIGINT AS stock_chars
  FROM w LEFT JOIN per p USING (r) LEFT JOIN covered v USING (r)),
b AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT} * n_words AS base_failed FROM c)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND 100 * (lost_chars - stock_chars) <= {MAX_LOST} * (word_chars - stock_chars)
    AND word_chars > stock_chars AS kept, n_lines_removed, lost_chars
FROM b
"""

QUERIES = {"op2_quality_rules": op2_quality_rules}
ORACLES = {"op2_quality_rules": SQL}
