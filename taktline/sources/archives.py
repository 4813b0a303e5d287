"""Timetable archives: ZIP files to rows, rows to typed tables.

An archive cannot be split, so that one task opens one archive. Its members are
read as streams and handed on in batches; only members below ``SMALL_BYTES``
are held whole, and their lines are cut into cells by Arrow, many archives at
once. Records travel from Python in lists, one list per member, and become rows
in Spark, so that steps which need no rows (the errors) make none. Save the
result once (``write_members``) and read typed tables from it.

A file that fails while it is read gives an error row after the rows it gave
before. Each row says whether its file was read to its end (``whole``), so that
``split_errors`` keeps rows of whole archives, and reports the rest, without a
join of all rows.
"""

from __future__ import annotations

import codecs
import csv
import io
import itertools
import struct
import zipfile
import zlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from taktline.constants import ARCHIVE_KEYS, WEEKDAY_COLUMNS
from taktline.functions import classify_dataset, gtfs_seconds, num, parse_date2

A = list(ARCHIVE_KEYS)
TABLES = (
    "agency.txt", "routes.txt", "trips.txt", "stops.txt", "stop_times.txt", "calendar.txt",
    "calendar_dates.txt", "feed_info.txt",
)
BATCH_ROWS = 8192
SMALL_BYTES = 1 << 17  # of a member that is held whole; no cell of it is above the limit of csv
HELD_RECORDS = 1 << 15  # of a file that is read once; a longer one is read a second time, when its outcome is known
BATCH_BYTES = 4 << 20  # of small members from which a batch is closed
DIRECTORY_ENTRY = struct.Struct("<4s2x3H4x3L3H8xL")  # of a ZIP file: what is read of it
NAME_LENGTHS = struct.Struct("<2H")
WRITERS = "spark.sql.maxConcurrentOutputFileWriters"
ROW_GROUP_BYTES = 16 << 20
#: Records of a member in lists: row ``first_ix`` + i has ``cells[i]`` under ``names``, NULL for the header.
ARROW_MEMBER = pa.schema(
    [
        ("path", pa.string()), ("member", pa.string()), ("header", pa.list_(pa.string())),
        ("first_ix", pa.int64()), ("names", pa.list_(pa.string())), ("cells", pa.list_(pa.list_(pa.string()))),
        ("error", pa.string()), ("whole", pa.bool_()),
    ]
)


def read_binary(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """Files with content, one row each."""
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path)


def archive_digest(files: DataFrame) -> DataFrame:
    """SHA-256 and size of each file."""
    return files.select(
        "path", F.sha2("content", 256).alias("sha256"),
        F.octet_length("content").cast("bigint").alias("bytes"),
    )


def payload_sniff(content: Column, content_type: Column) -> Column:
    """What a downloaded payload is; web pages are refused."""
    kind = F.lower(F.coalesce(content_type, F.lit("")))
    head = F.substring(content, 1, 4096)
    # A comma is one byte in UTF-8 and never part of a longer character.
    has_comma = F.decode(head, "ISO-8859-1").contains(",")
    return (
        F.when(kind.contains("html"), "rejected_html")
        .when(F.hex(F.substring(content, 1, 4)) == "504B0304", "zip")
        .when(kind.contains("csv") | has_comma, "csv")
        .otherwise("bin")
    )


def _as_text(binary) -> io.TextIOBase:
    return io.TextIOWrapper(binary, encoding="utf-8-sig", errors="replace", newline="")


def _open_texts(path: str, content: bytes, wanted: frozenset[str] | None) -> Iterator[tuple[str, io.TextIOBase]]:
    """CSV members of a ZIP, or the file itself when it is a CSV file."""
    if path.lower().endswith(".csv"):
        yield path.rsplit("/", 1)[-1], _as_text(io.BytesIO(content))
        return
    with zipfile.ZipFile(io.BytesIO(content)) as archive:
        seen: set[str] = set()
        for name in archive.namelist():
            lower = name.lower()
            if wanted is None and lower.endswith(".csv"):
                yield name, _as_text(archive.open(name))
            elif wanted is not None and lower in wanted and lower not in seen:
                seen.add(lower)
                yield lower, _as_text(archive.open(name))


def _member_records(path: str, member: str, text: io.TextIOBase) -> Iterator[tuple]:
    """Records with the names and the cells of a row apart; what csv.DictReader would give."""
    with text:
        reader = csv.reader(text)
        header = next(reader, [])
        width, plain = len(header), len(set(header)) == len(header)
        yield path, member, header, 0, None, None, None
        row_ix = 0
        for cells in reader:
            if not cells:
                continue
            row_ix += 1
            if len(cells) != width:
                cells = cells[:width] + [None] * (width - len(cells))
            if plain:
                yield path, member, header, row_ix, header, cells, None
            else:  # of columns with one name the last counts
                row = dict(zip(header, cells))
                yield path, member, header, row_ix, [*row], [*row.values()], None


def _records(path: str, content: bytes, wanted: frozenset[str] | None) -> Iterator[tuple]:
    """Records of all wanted members of a file."""
    for member, text in _open_texts(path, content, wanted):
        yield from _member_records(path, member, text)


def _lists(lists: tuple) -> tuple[pa.Array, pa.Array]:
    """Offsets of lists of text, NULL where there is none, and their values one after the other."""
    ends = [0, *itertools.accumulate(len(x or ()) for x in lists)]
    offsets = [at if x is not None else None for at, x in zip(ends, lists)]
    values = itertools.chain.from_iterable(x for x in lists if x is not None)
    return pa.array([*offsets, ends[-1]], pa.int32()), pa.array([*values], pa.string())


def _to_members(rows: list[tuple], whole: list[bool] | None = None) -> pa.RecordBatch:
    """Records as a batch of lists of one; cells become Arrow text in one go, which takes a fraction of the time of a map per row."""
    *plain, header, row_ix, names, cells, error = zip(*rows)
    offsets, values = _lists(cells)
    own = pa.array([x is None for x in row_ix])
    one = pa.ListArray.from_arrays(pa.array(range(len(rows) + 1), pa.int32()), pa.ListArray.from_arrays(offsets, values), mask=own)
    columns = [pa.array(c, pa.string()) for c in plain] + [
        pa.ListArray.from_arrays(*_lists(header)), pa.array(row_ix, pa.int64()), pa.ListArray.from_arrays(*_lists(names)), one,
        pa.array(error, pa.string()), pa.array(whole or [None] * len(rows), pa.bool_())]
    return pa.RecordBatch.from_arrays(columns, names=[*A[: len(plain) - 2], *ARROW_MEMBER.names])


def _to_arrow(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = [pa.array(c, type=f.type) for c, f in zip(zip(*rows), schema)]
    return pa.RecordBatch.from_arrays(columns, schema=schema)


def _batches(records: Iterable[tuple], schema: pa.Schema | None = None) -> Iterator[pa.RecordBatch]:
    """Batches of the given schema; without one, records of members."""
    held: list[tuple] = []
    for record in records:
        held.append(record)
        if len(held) == BATCH_ROWS:
            yield _to_arrow(held, schema) if schema else _to_members(held)
            held = []
    if held:
        yield _to_arrow(held, schema) if schema else _to_members(held)


def _with_outcome(read: Callable[[], Iterator[tuple]], failed_row: tuple) -> Iterator[tuple[tuple, bool]]:
    """Records, an error row after those of a file that fails, and whether the file is read to its end.

    The outcome is known before the first record is handed on: a file with more than ``HELD_RECORDS`` is read twice.
    """
    held: list[tuple] = []
    error, long = None, False
    try:
        for record in read():
            long = long or len(held) == HELD_RECORDS
            if not long:
                held.append(record)
    except Exception as e:
        error = repr(e)
    records = iter(held)
    if long:
        held.clear()
        records = read()
    try:
        for record in records:
            yield record, error is None
    except Exception as e:
        error = repr(e)
    if error is not None:
        yield (*failed_row, error), False


def _small_members(content: bytes, wanted: frozenset[str] | None) -> list[tuple[str, bytes]] | None:
    """Names and content of the wanted members of an ordinary archive of small members that are all sound.

    None for anything else: ``zipfile`` says then what can be read and what is wrong.
    """
    end = len(content) - 22
    if end < 0 or content[end : end + 4] != b"PK\5\6" or content[max(0, end - 20) : end - 16] == b"PK\6\7":
        return None
    disk, first_disk, here, entries, size, at, comment = struct.unpack_from("<4H2LH", content, end + 4)
    if disk or first_disk or here != entries or comment or at + size != end:
        return None
    chosen, starts, names, seen = [], [at], set(), set()
    for _ in range(entries):
        if at + 46 > end:
            return None
        signature, version, flags, method, crc, packed, raw, n, extra, note, start = DIRECTORY_ENTRY.unpack_from(content, at)
        name = content[at + 46 : at + 46 + n]
        at += 46 + n + note
        # Names beyond ASCII, extra fields, encryption and the like are for zipfile.
        if signature != b"PK\1\2" or version > 63 or flags & ~0x80E or method not in (0, 8) or extra or len(name) != n or not name.isascii() or b"\0" in name:
            return None
        starts.append(start)
        names.add(name)
        text = name.decode()
        lower = text.lower()
        if lower.endswith(".csv") if wanted is None else lower in wanted and lower not in seen:
            if raw > SMALL_BYTES:
                return None
            seen.add(lower)
            chosen.append((text if wanted is None else lower, name, start, method, crc, packed, raw))
    if at != end or len(names) != entries or len(set(starts)) != entries + 1:
        return None
    starts.sort()
    out = []
    for text, name, start, method, crc, packed, raw in chosen:
        if content[start : start + 4] != b"PK\3\4" or start + 30 > end:
            return None
        n, extra = NAME_LENGTHS.unpack_from(content, start + 26)
        begin = start + 30 + n + extra
        after = next((s for s in starts if s > start), 0)
        if content[start + 30 : start + 30 + n] != name or begin + packed > after:
            return None
        data = content[begin : begin + packed]
        if method:
            unpack = zlib.decompressobj(-15)
            try:
                data = unpack.decompress(data, raw + 1)
            except zlib.error:
                return None
            if not unpack.eof:
                return None
        if len(data) != raw or zlib.crc32(data) != crc:
            return None
        out.append((text, data))
    return out


def _plain(data: bytes) -> str | None:
    """Text whose lines and cells end at line ends and commas, without the last line end; None where csv has more to say."""
    if b'"' in data:
        return None
    text = data.removeprefix(codecs.BOM_UTF8).decode("utf-8", "replace")
    if "\r" in text:
        text = text.replace("\r\n", "\n")
        if "\r" in text:
            return None
    text = text.removesuffix("\n")
    return None if not text or text[0] == "\n" or text[-1] == "\n" or "\n\n" in text else text


class _Small:
    """Small sound members of many archives, cut into cells by Arrow."""

    def __init__(self, keys: int):
        self.keys, self.size = keys, 0
        self.own: list[tuple] = []
        self.members: list[tuple[str, bytes, str]] = []

    def add(self, own: tuple, member: str, data: bytes, text: str) -> None:
        self.own.append(own)
        self.members.append((member, data, text))
        self.size += len(data)

    def batch(self) -> tuple[pa.RecordBatch, list[int]]:
        """The records of members whose lines have as many cells as their header, and the numbers of the others."""
        texts = [text for _, _, text in self.members]
        headers = [text.partition("\n")[0].split(",") for text in texts]
        lines = pc.split_pattern(pa.array(texts, pa.string()), "\n")
        cells = pc.split_pattern(lines.values, ",")
        offsets = lines.offsets.to_numpy()
        width = np.array([len(h) for h in headers], np.int64)
        uneven = pc.list_value_length(cells).to_numpy() != np.repeat(width, np.diff(offsets))
        other = np.add.reduceat(uneven.astype(np.int64), offsets[:-1]) > 0
        other |= np.fromiter((len(set(h)) != len(h) for h in headers), bool, len(headers))
        first = np.zeros(len(cells), bool)
        first[offsets[:-1]] = True
        rows = pa.ListArray.from_arrays(lines.offsets, pa.ListArray.from_arrays(cells.offsets, cells.values, mask=pa.array(first)))
        names = pa.array(headers, pa.list_(pa.string()))
        n = len(texts)
        columns = [pa.array([o[i] for o in self.own], pa.string()) for i in range(self.keys + 1)] + [
            pa.array([m for m, _, _ in self.members], pa.string()), names, pa.array(np.zeros(n, np.int64)), names, rows,
            pa.nulls(n, pa.string()), pa.array(np.ones(n, bool))]
        made = pa.RecordBatch.from_arrays(columns, names=[*A[: self.keys], *ARROW_MEMBER.names])
        return (made.filter(pa.array(~other)) if other.any() else made), np.flatnonzero(other).tolist()


def _cell_batches(files: Iterable[tuple[tuple, bytes]], wanted: frozenset[str] | None, keys: int) -> Iterator[pa.RecordBatch]:
    """Records of files (keys and path, content) in batches of ``ARROW_MEMBER`` with the keys in front."""
    small = _Small(keys)
    held: list[tuple] = []
    whole: list[bool] = []

    def flush_held() -> Iterator[pa.RecordBatch]:
        if held:
            yield _to_members(held, whole)
            held.clear()
            whole.clear()

    def slow(own: tuple, records: Iterable[tuple[tuple, bool]]) -> Iterator[pa.RecordBatch]:
        for record, sound in records:
            held.append(own[:-1] + record)
            whole.append(sound)
            if len(held) == BATCH_ROWS:
                yield from flush_held()

    def flush_small() -> Iterator[pa.RecordBatch]:
        nonlocal small
        if small.own:
            batch, other = small.batch()
            if batch.num_rows:
                yield batch
            for i in other:  # without quotes and long cells nothing can fail
                member, data, _ = small.members[i]
                yield from slow(small.own[i], ((r, True) for r in _member_records(small.own[i][-1], member, _as_text(io.BytesIO(data)))))
            small = _Small(keys)

    for own, content in files:
        path = own[-1]
        found = None
        if path is not None and content is not None:
            if not path.lower().endswith(".csv"):
                found = _small_members(content, wanted)
            elif len(content) <= SMALL_BYTES:
                found = [(path.rsplit("/", 1)[-1], content)]
        if found is None:
            read = lambda: _records(path, content, wanted)
            yield from slow(own, _with_outcome(read, (path, None, None, None, None, None)))
            continue
        texts = [_plain(data) for _, data in found]
        if None in texts:
            read = lambda: itertools.chain.from_iterable(_member_records(path, m, _as_text(io.BytesIO(d))) for m, d in found)
            yield from slow(own, _with_outcome(read, (path, None, None, None, None, None)))
            continue
        for (member, data), text in zip(found, texts):
            small.add(own, member, data, text)
        if small.size >= BATCH_BYTES or len(small.own) >= BATCH_ROWS:
            yield from flush_small()
    yield from flush_small()
    yield from flush_held()


def unzip_members(files: DataFrame, members: tuple[str, ...] | None = TABLES) -> DataFrame:
    """CSV records of the wanted members (None: every CSV file of the archive).

    Member names match without regard to case. A file that cannot be read gives
    one row with ``error`` and does not stop the others; its other rows are not
    ``whole``. Archive keys of the files go along with every row.
    """
    wanted = None if members is None else frozenset(m.lower() for m in members)
    keys = [k for k in A if k in files.columns]
    texts = "".join(f"{k} string, " for k in keys)
    schema = f"{texts}path string, member string, header array<string>, first_ix long, names array<string>, cells array<array<string>>, error string, whole boolean"

    def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, bytes]]:
        for batch in batches:
            for path, content, *own in zip(*(batch.column(k) for k in ("path", "content", *keys))):
                yield (*(k.as_py() for k in own), path.as_py()), content.as_py()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [*keys, *ARROW_MEMBER.names]
        return (b.rename_columns(names) for b in _cell_batches(opened(batches), wanted, len(keys)))

    packed = files.select("path", "content", *keys).mapInArrow(run, schema)
    rows = packed.select(*keys, "path", "member", "header", "first_ix", "names", F.posexplode_outer("cells").alias("_at", "_cells"), "error", "whole")
    return rows.select(
        *keys, "path", "member", "header", (F.col("first_ix") + F.col("_at")).alias("row_ix"),
        F.map_from_arrays("names", "_cells").alias("row"), "error", "whole")


def archive_errors(members: DataFrame) -> DataFrame:
    """Archives that could not be read, with their keys as far as they are known."""
    return members.where("error IS NOT NULL").select(*[k for k in A if k in members.columns], "path", "error")


def split_errors(members: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows of archives that were read to their end, and the errors of all others.

    A row says itself whether its file was read to its end. Only a path that stands for several files, of which some
    failed, is left to a join; there is none where a path has one content. Members saved without ``whole`` are joined.
    """
    errors = archive_errors(members)
    rows = members.where("error IS NULL")
    if "whole" not in members.columns:
        return rows.join(errors.select("path").distinct(), "path", "left_anti"), errors
    # The header of a member is one row of each whole file that has rows.
    outcomes = members.where("error IS NOT NULL OR (row_ix = 0 AND whole)").groupBy("path").agg(
        F.bool_or(F.col("error").isNotNull()).alias("failed"), F.bool_or(F.col("error").isNull()).alias("read"))
    both = F.broadcast(outcomes.where("failed AND read").select("path"))
    return rows.where("whole").join(both, "path", "left_anti"), errors


def path_key(path: Column) -> Column:
    """A path without scheme, authority, repeated or leading separators."""
    plain = F.regexp_replace(F.replace(path, F.lit("\\"), F.lit("/")), r"^[A-Za-z][A-Za-z0-9+.\-]+:(//[^/]*)?", "")
    return F.regexp_replace(F.regexp_replace(plain, r"/(\./)*/*", "/"), r"^(\./|/)+", "")


def file_name(key: Column) -> Column:
    """Last component of a path key."""
    return F.element_at(F.split(key, "/"), -1)


def same_file(a: Column, b: Column) -> Column:
    """Two path keys name one file if one ends with the other, whole components only."""
    slash = F.lit("/")
    return (a == b) | F.endswith(F.concat(slash, a), F.concat(slash, b)) | F.endswith(F.concat(slash, b), F.concat(slash, a))


def _keyed(df: DataFrame, manifest: DataFrame, how: str) -> DataFrame:
    """Rows with the keys of the manifest row of their file.

    Readers give absolute paths; a manifest may have relative ones.
    """
    own = df.drop(*A).withColumn("_key", path_key(F.col("path"))).withColumn("_name", file_name(F.col("_key")))
    listed = (
        manifest.where("path <> ''").select(*A, path_key(F.col("path")).alias("_listed"))
        .withColumn("_listed_name", file_name(F.col("_listed"))))
    same = same_file(F.col("_key"), F.col("_listed"))
    return own.join(listed, (F.col("_name") == F.col("_listed_name")) & same, how).drop("_key", "_name", "_listed", "_listed_name")


def keyed_files(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """Files with archive keys; attach them before unzipping, to join files and not rows."""
    return _keyed(files, manifest, "inner")


def unlisted_files(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """Files that no manifest row names."""
    return _keyed(files.select("path"), manifest, "left").where(F.col(A[0]).isNull()).select("path")


def with_archive_keys(members: DataFrame, manifest: DataFrame) -> DataFrame:
    """Attach the archive keys of the manifest to the rows of its files."""
    return _keyed(members, manifest, "inner")


def write_members(members: DataFrame, path: str) -> None:
    """Save rows and errors once, a folder per member: readers then see one table only.

    Files of all members are written side by side, for which rows need no order; a task with more members than there are
    tables sorts the rows of the rest. Small row groups keep several open files in bounded memory.
    """
    conf = members.sparkSession.conf
    before = conf.get(WRITERS)
    conf.set(WRITERS, str(len(TABLES) + 1))
    try:
        members.write.mode("overwrite").partitionBy("member").option("parquet.block.size", ROW_GROUP_BYTES).parquet(path)
    finally:
        conf.set(WRITERS, before)


# -- typed tables -------------------------------------------------------------


def _cell(name: str) -> Column:
    return F.col("row")[name]


def _table(members: DataFrame, member: str, **columns: Column) -> DataFrame:
    rows = members.where((F.col("member") == member) & F.col("row").isNotNull())
    return rows.select(*A, *[c.alias(n) for n, c in columns.items()], "row_ix")


def _texts(*names: str) -> dict[str, Column]:
    return {n: _cell(n) for n in names}


def agency_table(members: DataFrame) -> DataFrame:
    return _table(members, "agency.txt", **_texts("agency_id", "agency_name", "agency_url"))


def routes_table(members: DataFrame) -> DataFrame:
    return _table(members, "routes.txt", **_texts("route_id", "agency_id", "route_type"))


def trips_table(members: DataFrame) -> DataFrame:
    # Some feeds state a departure time per trip.
    return _table(members, "trips.txt", **_texts("trip_id", "route_id", "service_id", "departure_time"))


def stops_table(members: DataFrame) -> DataFrame:
    return _table(
        members, "stops.txt", stop_id=F.coalesce(_cell("stop_id"), F.lit("")),
        stop_lat=_cell("stop_lat").try_cast("double"), stop_lon=_cell("stop_lon").try_cast("double"),
    )


def stop_times_table(members: DataFrame) -> DataFrame:
    return _table(
        members, "stop_times.txt", **_texts("trip_id", "stop_id"),
        stop_sequence=num(_cell("stop_sequence")),
        arrival_sec=gtfs_seconds(_cell("arrival_time")), departure_sec=gtfs_seconds(_cell("departure_time")),
    )


def calendar_table(members: DataFrame) -> DataFrame:
    flags = F.array(*[F.coalesce(_cell(d), F.lit("0")) == "1" for d in WEEKDAY_COLUMNS])
    return _table(
        members, "calendar.txt", service_id=F.coalesce(_cell("service_id"), F.lit("")),
        start_date=parse_date2(_cell("start_date")), end_date=parse_date2(_cell("end_date")), flags=flags,
    )


def calendar_dates_table(members: DataFrame) -> DataFrame:
    return _table(
        members, "calendar_dates.txt", service_id=F.coalesce(_cell("service_id"), F.lit("")),
        date=parse_date2(_cell("date")), exception_type=num(_cell("exception_type")),
    )


def feed_info_table(members: DataFrame) -> DataFrame:
    return _table(
        members, "feed_info.txt", feed_start_date=parse_date2(_cell("feed_start_date")),
        feed_end_date=parse_date2(_cell("feed_end_date")),
    )


# -- operator-statistics files ------------------------------------------------

LOG_NAME = "fetch_status.csv"


def links_files(spark: SparkSession, folder: str) -> DataFrame:
    """Candidate files: csv, zip, xlsx or xls, without the fetch log."""
    name = F.element_at(F.split("path", "/"), -1)
    return (
        read_binary(spark, folder, "*.{csv,CSV,zip,ZIP,xlsx,XLSX,xls,XLS}")
        .withColumn("name", name).where(F.lower("name") != LOG_NAME)
    )


def _is_spreadsheet(path: Column) -> Column:
    lower = F.lower(path)
    return F.endswith(lower, F.lit(".xls")) | F.endswith(lower, F.lit(".xlsx"))


def links_records(files: DataFrame) -> DataFrame:
    """Records of CSV files and of CSV files inside ZIP files, with the path of the file they come from.

    Files that fail give no rows at all; ``links_status`` says so.
    """
    rows, _ = split_errors(unzip_members(files.where(~_is_spreadsheet(F.col("path"))), None))
    return rows.select(
        "path", F.col("member").alias("source_file"), classify_dataset(F.col("member")).alias("dataset"),
        F.col("row_ix").alias("source_row"), F.col("header").alias("columns"), "row",
    )


def links_status(files: DataFrame) -> DataFrame:
    """One row per file: read, unreadable, without CSV members, or a spreadsheet that is not decoded."""
    csv_files = files.where(~_is_spreadsheet(F.col("path")))
    seen = unzip_members(csv_files, None).groupBy("path").agg(
        F.max("error").alias("error"), F.count("row").alias("rows"), F.count_if(F.col("member").isNotNull() & F.col("row").isNull()).alias("members")
    )
    status = (
        F.when(_is_spreadsheet(F.col("path")), "spreadsheet_not_decoded")
        .when(F.col("error").isNotNull(), "unreadable")
        .when(F.coalesce("members", F.lit(0)) == 0, "no_csv_member")
        .otherwise("read")
    )
    return files.select("path").join(seen, "path", "left").select(
        "path", status.alias("status"),
        F.when(status == "read", F.col("rows")).alias("rows"), "error",
    )
