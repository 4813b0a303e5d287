"""Archive members as units of work: central directories first, then one stream per member.

``unzip_members`` takes whole files as rows and gives maps of text, which suits statistics files. Here no file content is
a value in a row, so that an archive may be larger than a cell can be. Spark lists the files; tasks read the end of each
archive, where its directory stands; a second job opens each wanted member at its place and parses the columns that its
table has. Members of one archive are read by different tasks. A single member stays with one task, since a compressed
stream has no entry points; it is parsed in batches and never held whole.

Tasks open files through ``pyarrow.fs``. Stores that it has no file system for are refused by ``openable``; read those with
``read_binary`` and ``unzip_members``.

Defined cases: a file that is no archive, and a member that fails anywhere, make the whole archive an error, and none of
its rows is given; of two names that differ in case only the first counts; a member without a line has no rows; cells
that a line or the header lacks are NULL; of two columns with one name the last counts; no files give empty tables; Spark's
listing leaves out files without a byte.
"""

from __future__ import annotations

import csv
import io
import zipfile
from collections.abc import Callable, Iterator
from functools import reduce
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, functions as F

from taktline.constants import ARCHIVE_KEYS, WEEKDAY_COLUMNS
from taktline.sources import archives as src
from taktline.workspace import Workspace

A = list(ARCHIVE_KEYS)
TASK_BYTES = 64 << 20  # of unpacked members that one task is meant to read

#: Columns that the typed tables use.
COLUMNS = {
    "agency.txt": ("agency_id", "agency_name", "agency_url"),
    "routes.txt": ("route_id", "agency_id", "route_type"),
    "trips.txt": ("trip_id", "route_id", "service_id", "departure_time"),
    "stops.txt": ("stop_id", "stop_lat", "stop_lon"),
    "stop_times.txt": ("trip_id", "stop_id", "stop_sequence", "arrival_time", "departure_time"),
    "calendar.txt": ("service_id", *WEEKDAY_COLUMNS, "start_date", "end_date"),
    "calendar_dates.txt": ("service_id", "date", "exception_type"),
    "feed_info.txt": ("feed_start_date", "feed_end_date"),
}
#: The typed table of each member.
TYPED: dict[str, Callable[[DataFrame], DataFrame]] = {
    "agency.txt": src.agency_table, "routes.txt": src.routes_table, "trips.txt": src.trips_table,
    "stops.txt": src.stops_table, "stop_times.txt": src.stop_times_table, "calendar.txt": src.calendar_table,
    "calendar_dates.txt": src.calendar_dates_table, "feed_info.txt": src.feed_info_table,
}


def list_archives(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """Paths and sizes of files; their content is not read."""
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path).select("path", "length")


def _located(path: str) -> tuple[fs.FileSystem, str]:
    scheme, colon, rest = path.partition(":")
    if not colon or "/" in scheme:
        return fs.LocalFileSystem(), path
    if scheme == "file":
        return fs.LocalFileSystem(), "/" + rest.lstrip("/")
    return fs.FileSystem.from_uri(f"{scheme}:{quote(rest, safe='/:@')}")


def openable(path: str) -> bool:
    """Tasks have a file system for the store of this path."""
    try:
        _located(path)
    except (pa.ArrowInvalid, OSError, ImportError, NotImplementedError):
        return False
    return True


def _open(path: str):
    store, name = _located(path)
    return store.open_input_file(name)


def _entries(path: str, wanted: frozenset[str]) -> Iterator[tuple[str, str, int]]:
    with _open(path) as file, zipfile.ZipFile(file) as archive:
        seen: set[str] = set()
        for info in archive.infolist():
            member = info.filename.lower()
            if member in wanted and member not in seen:
                seen.add(member)
                yield member, info.filename, info.file_size


def member_names(files: DataFrame) -> DataFrame:
    """All member names of each archive (archive keys if known, path) in the order of its directory, joined by ``|``;
    an archive whose directory cannot be read has NULL and an error."""
    own = [*(k for k in A if k in files.columns), "path"]
    schema = "".join(f"{k} string, " for k in own) + "gtfs_members string, error string"
    arrow = pa.schema([(k, pa.string()) for k in (*own, "gtfs_members", "error")])

    def names(path: str) -> tuple[str | None, str | None]:
        try:
            with _open(path) as file, zipfile.ZipFile(file) as archive:
                return "|".join(archive.namelist()), None
        except Exception as error:
            return None, repr(error)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return src._batches(((*row, *names(row[-1])) for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns))), arrow)

    return files.select(*own).repartition(files.sparkSession.sparkContext.defaultParallelism).mapInArrow(run, schema)


def _lines(path: str, name: str, columns: tuple[str, ...]) -> Iterator[tuple]:
    """Number and wanted cells of each record."""
    with _open(path) as file, zipfile.ZipFile(file) as archive, archive.open(name) as binary:
        reader = csv.reader(io.TextIOWrapper(binary, encoding="utf-8-sig", errors="replace", newline=""))
        place = {column: i for i, column in enumerate(next(reader, []))}
        at = [place.get(c, -1) for c in columns]
        for row_ix, line in enumerate(filter(None, reader), 1):
            yield row_ix, *(line[i] if 0 <= i < len(line) else None for i in at)


class Archives:
    """Members of the listed files (path, archive keys if known), each unpacked once into a table of the workspace."""

    def __init__(self, files: DataFrame, workspace: Workspace, columns: dict[str, tuple[str, ...]] = COLUMNS):
        self.keys = [k for k in A if k in files.columns]
        self.columns, self.workspace = columns, workspace
        self.directory = workspace.keep(self._directory(files), "directory")
        plan = self.directory.where("error IS NULL").groupBy("member").agg(F.count("*"), F.sum("size")).collect()
        self.sizes = {member: (n, size) for member, n, size in plan}  # one row per member name
        self.kept = {member: workspace.keep(self._unpacked(member), member.split(".")[0]) for member in columns}

    def _own(self) -> str:
        return "".join(f"{k} string, " for k in self.keys) + "path string, "

    def _directory(self, files: DataFrame) -> DataFrame:
        wanted, n = frozenset(self.columns), len(self.keys) + 1
        schema = self._own() + "member string, name string, size long, error string"
        arrow = pa.schema([(k, pa.string()) for k in [*self.keys, "path", "member", "name"]] + [("size", pa.int64()), ("error", pa.string())])

        def records(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
            for batch in batches:
                for own in zip(*(c.to_pylist() for c in batch.columns[:n])):
                    try:
                        found = [(*entry, None) for entry in _entries(own[-1], wanted)]
                    except Exception as error:
                        found = [(None, None, None, repr(error))]
                    yield from (own + entry for entry in found)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            return src._batches(records(batches), arrow)

        spread = files.select(*self.keys, "path").repartition(files.sparkSession.sparkContext.defaultParallelism)
        return spread.mapInArrow(run, schema)

    def _tasks(self, member: str) -> int:
        n, size = self.sizes.get(member, (0, 0))
        return max(1, -(-size // TASK_BYTES), min(n, self.directory.sparkSession.sparkContext.defaultParallelism))

    def _unpacked(self, member: str) -> DataFrame:
        columns, own_names = self.columns[member], [*self.keys, "path"]
        n = len(own_names)
        cells = ", ".join(f"`{c}`: string" for c in columns)
        schema = self._own() + f"row_ix long, row struct<{cells}>, error string"
        flat = pa.schema([(k, pa.string()) for k in [*self.keys, "path"]] + [("row_ix", pa.int64())]
                         + [(f"row.{c}", pa.string()) for c in columns] + [("error", pa.string())])

        def records(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
            for batch in batches:
                for *own, name in zip(*(c.to_pylist() for c in batch.columns)):
                    try:
                        for line in _lines(own[-1], name, columns):
                            yield *own, *line, None
                    except Exception as error:
                        yield *own, *[None] * (len(columns) + 1), repr(error)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in src._batches(records(batches), flat):
                held = batch.columns
                row = pa.StructArray.from_arrays(held[n + 1 : -1], names=list(columns))
                yield pa.RecordBatch.from_arrays([*held[: n + 1], row, held[-1]], names=[*own_names, "row_ix", "row", "error"])

        entries = self.directory.where((F.col("member") == member) & F.col("error").isNull())
        # A number of tasks that is asked for isn't merged again because the names of members are short.
        return entries.select(*self.keys, "path", "name").repartition(self._tasks(member), "path").mapInArrow(run, schema)

    def errors(self) -> DataFrame:
        """Archives that could not be read to their end, with the first failure of each kind of member."""
        parts = [self.directory, *self.kept.values()]
        failed = [p.where("error IS NOT NULL").select(*self.keys, "path", "error") for p in parts]
        return reduce(DataFrame.unionByName, failed)

    def rows(self, member: str) -> DataFrame:
        """Records of one member in archives that were read to their end; ``row`` is a struct of its columns."""
        failed = self.errors().select("path").distinct()
        return self.kept[member].where("error IS NULL").drop("error").join(failed, "path", "left_anti").withColumn("member", F.lit(member))

    def tables(self) -> dict[str, DataFrame]:
        """Typed tables by name; the files need archive keys."""
        return {member.split(".")[0]: typed(self.rows(member)) for member, typed in TYPED.items()}
