"""CSV files of any size, read by byte ranges.

A line end inside quotes ends no record, so that a range does not know by itself where its first record begins. Two jobs
find out:

1. Each range says what it does to the state of a reader: out of quotes, in quotes, or just behind a quote that may be the
   closing one or half of a doubled one. That is one small map of three states; the maps of a file, one after the other,
   give the state at the beginning of each range.
2. Each range skips to its first record and parses all records that begin in it, the last one beyond its end. The header
   is read again from the head of the file by each task.

Records are numbered by the counts of the ranges before. The dialect is that of the csv module: a quote opens a field only
at its beginning, records end at \\n, \\r or \\r\\n, a mark of the byte order is skipped, bytes that are no UTF-8 are
replaced.

Defined cases: a row without cells is no record; cells that a record lacks are NULL, cells beyond the header are dropped;
of two columns with one name the last counts; a file with a header alone has its row 0 only, as with ``unzip_members``; a file
that fails in any range gives an error and no rows; no files give empty tables. A record is parsed by one task and
must fit into it (the csv module takes fields up to 131,072 characters).
"""

from __future__ import annotations

import csv
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from taktline.functions import classify_dataset
from taktline.sources import archives as src
from taktline.sources.members import _open
from taktline.workspace import Workspace

RANGE_BYTES = 16 << 20
BLOCK = 1 << 20  # bytes read at once
OUT, IN, BEHIND = 0, 1, 2  # states: out of quotes, in quotes, behind a quote within a quoted field
BOM = b"\xef\xbb\xbf"

_OPENING = re.compile(rb'(?<=[,\r\n])"')
_OPENING_OR_END = re.compile(rb'(?<=[,\r\n])"|\r\n?|\n')
_QUOTED = re.compile(rb'[^"]*+(?:""[^"]*+)*+')
_LINE = re.compile(rb"[^\r\n]*+(?:\r\n|\r(?!\Z)|\n)")


def _walk(data: bytes, state: int, to_line_end: bool = False) -> tuple[int, int]:
    """State behind ``data`` and its length, or, on demand, the place behind the first line end out of quotes.

    ``data`` begins with the byte before the range; a line end gives state -1.
    """
    at, n = 1, len(data)
    wanted = _OPENING_OR_END if to_line_end else _OPENING
    while True:
        if state == IN:
            at = _QUOTED.match(data, at).end()
            if at == n:
                return IN, n
            at, state = at + 1, BEHIND
        if state == BEHIND:
            if at == n:
                return BEHIND, n
            if data[at] == 0x22:
                at, state = at + 1, IN
                continue
            state = OUT
        found = wanted.search(data, at)
        if found is None:
            return OUT, n
        if found[0] != b'"':
            return -1, found.end()
        at, state = found.end(), IN


def states_after(data: bytes) -> list[int]:
    """State at the end of a range for each state at its beginning; ``data`` begins with the byte before it."""
    if data.find(b'"', 1) < 0:
        return [OUT, IN, OUT if len(data) > 1 else BEHIND]
    return [_walk(data, state)[0] for state in (OUT, IN, BEHIND)]


def first_record(data: bytes, state: int) -> int | None:
    """Offset in a range at which its first record begins, if one does; ``data`` begins with the byte before it."""
    if state == OUT and data[:1] == b"\n":
        return 0 if len(data) > 1 else None
    if state == OUT and data[:1] == b"\r":
        at = 1 if data[1:2] == b"\n" else 0
    else:
        state, end = _walk(data, state, True)
        if state != -1:
            return None
        at = end - 1
    return at if at < len(data) - 1 else None


class _Lines:
    """Decoded lines from a place of an open file on; ``at`` is the place behind the last one."""

    def __init__(self, file, at: int):
        self.file, self.at, self.held = file, at, b""
        file.seek(at)

    def __iter__(self) -> Iterator[str]:
        while True:
            block = self.file.read(BLOCK)
            data, place = self.held + block, 0
            while found := _LINE.match(data, place):
                place = found.end()
                self.at += len(found[0])
                yield found[0].decode("utf-8", "replace")
            self.held = data[place:]
            if not block:
                break
        if self.held:
            self.at += len(self.held)
            yield self.held.decode("utf-8", "replace")


def _head(file) -> int:
    file.seek(0)
    return len(BOM) if file.read(len(BOM)) == BOM else 0


def _read_range(file, start: int, stop: int, head: int) -> bytes:
    """The byte before the range (a line end before the first one) and the range."""
    begin = max(start, head)
    if begin == head:
        file.seek(head)
        return b"\n" + file.read(max(stop - head, 0))
    file.seek(begin - 1)
    return file.read(max(stop - begin, 0) + 1)


def _records(path: str, start: int, stop: int, state: int) -> Iterator[tuple]:
    """Header, local number and cells of the records that begin in a range; the header itself is number 0."""
    with _open(path) as file:
        head = _head(file)
        header = next(csv.reader(iter(_Lines(file, head))), [])
        if start == 0:
            yield header, 0, None
        offset = first_record(_read_range(file, start, stop, head), state)
        if offset is None:
            return
        lines = _Lines(file, max(start, head) + offset)
        reader = csv.reader(iter(lines))
        if start == 0:
            next(reader, None)
        number = 0
        while lines.at < stop:
            row = next(reader, None)
            if row is None:
                return
            if row:
                number += 1
                yield header, number, list(dict(zip(header, row + [None] * (len(header) - len(row)))).items())


class CsvFiles:
    """Records of the listed CSV files (path, length), parsed once into a table of the workspace."""

    def __init__(self, files: DataFrame, workspace: Workspace, range_bytes: int = RANGE_BYTES):
        self.workspace = workspace
        step = max(range_bytes, len(BOM) + 1)
        starts = files.where("length > 0").select(
            "path", F.explode(F.expr(f"sequence(0L, length - 1, {step}L)")).alias("start"), F.col("length"))
        ranges = starts.select("path", "start", F.least(F.col("start") + step, "length").alias("stop"))
        self.tasks = max(1, ranges.count())
        self.ranges = workspace.keep(self._entered(ranges), "csv_ranges")
        self.kept = workspace.keep(self._parsed(), "csv_rows")

    def _spread(self, ranges: DataFrame) -> DataFrame:
        # A range is a task: what Spark sees of it is a few bytes, which it would merge.
        return ranges.repartition(self.tasks, "path", "start")

    def _entered(self, ranges: DataFrame) -> DataFrame:
        """Ranges with the state at their beginning, or the error of the first pass."""
        arrow = pa.schema([("path", pa.string()), ("start", pa.int64()), ("stop", pa.int64()), ("after", pa.list_(pa.int32())), ("error", pa.string())])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for path, start, stop in zip(*(c.to_pylist() for c in batch.columns)):
                    try:
                        with _open(path) as file:
                            row = (path, start, stop, states_after(_read_range(file, start, stop, _head(file))), None)
                    except Exception as error:
                        row = (path, start, stop, [OUT, IN, BEHIND], repr(error))
                    yield src._to_arrow([row], arrow)

        mapped = self._spread(ranges).mapInArrow(run, "path string, start long, stop long, after array<int>, error string")
        schema = pa.schema([("path", pa.string()), ("start", pa.int64()), ("stop", pa.int64()), ("state", pa.int32()), ("error", pa.string())])

        def follow(group: pa.Table) -> pa.Table:
            # A file of a terabyte has 65,536 ranges of a few bytes each.
            state, rows = OUT, []
            for r in group.sort_by("start").to_pylist():
                rows.append((r["path"], r["start"], r["stop"], state, r["error"]))
                state = r["after"][state]
            return pa.Table.from_batches([src._to_arrow(rows, schema)])

        return mapped.groupBy("path").applyInArrow(follow, "path string, start long, stop long, state int, error string")

    def _parsed(self) -> DataFrame:
        arrow = pa.schema([
            ("path", pa.string()), ("start", pa.int64()), ("header", pa.list_(pa.string())), ("number", pa.int64()),
            ("row", pa.map_(pa.string(), pa.string())), ("error", pa.string())])

        def records(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
            for batch in batches:
                for path, start, stop, state in zip(*(c.to_pylist() for c in batch.columns)):
                    try:
                        for header, number, row in _records(path, start, stop, state):
                            yield path, start, header, number, row, None
                    except Exception as error:
                        yield path, start, None, None, None, repr(error)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            return src._batches(records(batches), arrow)

        wanted = self.ranges.where("error IS NULL").select("path", "start", "stop", "state")
        return self._spread(wanted).mapInArrow(
            run, "path string, start long, header array<string>, number long, row map<string,string>, error string")

    def errors(self) -> DataFrame:
        """Path and failure of each range that could not be read."""
        return self.ranges.where("error IS NOT NULL").select("path", "error").unionByName(
            self.kept.where("error IS NOT NULL").select("path", "error"))

    def rows(self) -> DataFrame:
        """Path, header, row number in the file (0: the file itself, without a row) and row of whole files."""
        before = F.expr("sum(n) OVER (PARTITION BY path ORDER BY start ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)")
        counts = self.kept.groupBy("path", "start").agg(F.count("row").alias("n"))
        offsets = counts.select("path", "start", F.coalesce(before, F.lit(0)).alias("before"))
        # One row per range at most, a few bytes for 16 MB: rows stay where they are, and a file is not one task's.
        failed = F.broadcast(self.errors().select("path").distinct())
        whole = self.kept.where("error IS NULL").join(failed, "path", "left_anti")
        return whole.join(F.broadcast(offsets), ["path", "start"]).select("path", "header", (F.col("number") + F.col("before")).alias("row_ix"), "row")


def _undivided(path: str, start: int, stop: int, state: int) -> Iterator[str]:
    """Text of the records that begin in a range, without line ends, blank lines and the first record of the file."""
    with _open(path) as file:
        head = _head(file)
        offset = first_record(_read_range(file, start, stop, head), state)
        if offset is None:
            return
        lines = _Lines(file, max(start, head) + offset)
        following, header = iter(lines), start == 0
        while lines.at < stop:
            held, state = [], OUT
            for line in following:
                held.append(line)
                if state != OUT or '"' in line:
                    state = _walk(b"\n" + line.encode(), state)[0]
                if state != IN:
                    break
            if not held:
                return
            text = "".join(held)
            text = text[: -2 if text.endswith("\r\n") else -1] if text.endswith(("\r", "\n")) else text
            if text and not header:
                yield text
            header &= not text


class CsvText(CsvFiles):
    """Records of the listed CSV files as text, in the order of paths and places; a file that cannot be read is an error."""

    def _parsed(self) -> DataFrame:
        arrow = pa.schema([("path", pa.string()), ("start", pa.int64()), ("number", pa.int64()), ("value", pa.string())])

        def records(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
            for batch in batches:
                for path, start, stop, state, error in zip(*(c.to_pylist() for c in batch.columns)):
                    if error is not None:
                        raise OSError(f"{path}: {error}")
                    for number, text in enumerate(_undivided(path, start, stop, state)):
                        yield path, start, number, text

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            return src._batches(records(batches), arrow)

        return self._spread(self.ranges.select("path", "start", "stop", "state", "error")).mapInArrow(
            run, "path string, start long, number long, value string")

    def numbered(self) -> DataFrame:
        """Number of the record among those of all files, from 0, and its text."""
        # One row per range: a few bytes for 16 MB.
        counts = self.kept.groupBy("path", "start").agg(F.count("*").alias("n"))
        before = F.expr("coalesce(sum(n) OVER (ORDER BY path, start ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)")
        offsets = F.broadcast(counts.select("path", "start", before.alias("before")))
        return self.kept.join(offsets, ["path", "start"]).select((F.col("before") + F.col("number")).alias("row_ix"), "value")


class Statistics:
    """Operator statistics in a folder: every file opened once, records and the outcome per file.

    CSV files are read by ranges, ZIP files by one task each, spreadsheets are not decoded.
    """

    def __init__(self, spark, folder: str, workspace: Workspace, range_bytes: int = RANGE_BYTES):
        name = F.element_at(F.split("path", "/"), -1)
        listed = (
            spark.read.format("binaryFile").option("pathGlobFilter", "*.{csv,CSV,zip,ZIP,xlsx,XLSX,xls,XLS}").load(folder)
            .where(F.lower(name) != src.LOG_NAME))
        ends = F.lower(F.element_at(F.split("path", "[.]"), -1))
        self.files = workspace.keep(listed.select("path", "length", ends.alias("kind")), "statistics_files")
        self.csv = CsvFiles(self.files.where("kind = 'csv'"), workspace, range_bytes)
        self.zipped = workspace.keep(src.unzip_members(listed.where(ends == "zip"), None), "statistics_members")

    def records(self) -> DataFrame:
        """As ``links_records``, of files that were read to their end."""
        zipped, _ = src.split_errors(self.zipped)
        plain = self.csv.rows().withColumn("member", F.element_at(F.split("path", "/"), -1))
        both = plain.unionByName(zipped.select("path", "header", "row_ix", "row", "member"))
        return both.select(
            "path", F.col("member").alias("source_file"), classify_dataset(F.col("member")).alias("dataset"),
            F.col("row_ix").alias("source_row"), F.col("header").alias("columns"), "row")

    def status(self) -> DataFrame:
        """One row per file: read, unreadable, without CSV members, or a spreadsheet that is not decoded."""
        zipped = self.zipped.select("path", "error", F.col("row").isNotNull().alias("counted"), F.col("member").isNotNull().alias("found"))
        plain = self.csv.kept.select("path", "error", F.col("row").isNotNull().alias("counted"), F.lit(True).alias("found"))
        failed = self.csv.ranges.where("error IS NOT NULL").select("path", "error", F.lit(False).alias("counted"), F.lit(True).alias("found"))
        seen = zipped.unionByName(plain).unionByName(failed).groupBy("path").agg(
            F.min("error").alias("error"), F.count_if("counted").alias("rows"), F.bool_or("found").alias("found"))
        status = (
            F.when(F.col("kind").isin("xls", "xlsx"), "spreadsheet_not_decoded")
            .when(F.col("error").isNotNull(), "unreadable")
            .when(~F.coalesce("found", F.lit(False)), "no_csv_member")
            .otherwise("read"))
        return self.files.join(seen, "path", "left").select(
            "path", status.alias("status"), F.when(status == "read", F.col("rows")).alias("rows"), "error")

    def records_or_none(self) -> DataFrame | None:
        """None if no file was read: what the statistics say is then unknown, not zero."""
        return self.records() if self.status().where("status = 'read'").limit(1).count() else None
