"""Content digests that do not depend on row or column order.

Each row is hashed; the hashes of a table are added up. A sum is combined on
the map side, so that a table of any size becomes one small row per task, and a
repeated row still changes the result.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, functions as F

from taktline.constants import ARCHIVE_KEYS, WEEKDAY_COLUMNS

A = list(ARCHIVE_KEYS)
MISSING = "MISSING"
CORE_MEMBERS = ("routes.txt", "trips.txt", "stop_times.txt")
CALENDAR_PARTS = {
    "calendar_patterns": ("calendar.txt", ("service_id", *WEEKDAY_COLUMNS)),
    "calendar_validity": ("calendar.txt", ("service_id", "start_date", "end_date")),
    "calendar_exceptions": ("calendar_dates.txt", ("service_id", "date", "exception_type")),
}


def row_hash(values: Column) -> Column:
    """SHA-256 of an array of cells; JSON keeps the cells apart."""
    return F.sha2(F.to_json(values), 256)


def _number(digest: Column, start: int) -> Column:
    return F.conv(F.substring(digest, start, 15), 16, 10).cast("decimal(38,0)")


def _sums(hashed: DataFrame, keys: list[str]) -> DataFrame:
    """Rows and two sums over 60 bits each of column ``h``; sums as text."""
    return hashed.groupBy(*keys).agg(
        F.count("h").alias("n_rows"),
        F.coalesce(F.sum(_number(F.col("h"), 1)), F.lit(0)).cast("string").alias("sum_1"),
        F.coalesce(F.sum(_number(F.col("h"), 16)), F.lit(0)).cast("string").alias("sum_2"),
    )


def _digest(header: Column) -> Column:
    return F.sha2(F.concat_ws("|", header, F.col("n_rows"), "sum_1", "sum_2"), 256)


def table_digest(df: DataFrame, keys: list[str] = [], columns: list[str] | None = None) -> DataFrame:
    """Digest of the named columns (default: all others) per key."""
    names = sorted(columns or [c for c in df.columns if c not in keys])
    cells = F.array(*[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in names])
    header = F.lit(json.dumps(names, ensure_ascii=False, separators=(",", ":")))
    hashed = df.select(*keys, row_hash(cells).alias("h"))
    return _sums(hashed, keys).withColumn("digest", _digest(header))


def member_parts(members: DataFrame) -> DataFrame:
    """Rows of archive members as the parts that make up a timetable.

    ``members``: archive keys, member, header ARRAY<STRING>, row MAP; a row
    with a NULL map only says that the member exists.
    """
    header = F.array_sort("header")

    def cells(names: Column) -> Column:
        return F.transform(names, lambda k: F.coalesce(F.get(F.array(F.col("row")[k]), F.lit(0)), F.lit("")))

    def part(name: Column | str, names: Column, member: str) -> Column:
        label = F.lit(name) if isinstance(name, str) else name
        return F.when(
            F.col("member") == member if member else F.col("member").isin(*CORE_MEMBERS),
            F.struct(label.alias("part"), F.to_json(names).alias("header"),
                     F.when(F.col("row").isNotNull(), row_hash(cells(names))).alias("h")),
        )

    parts = [part(F.col("member"), header, "")]
    for name, (member, columns) in CALENDAR_PARTS.items():
        parts.append(part(name, F.array(*[F.lit(c) for c in columns]), member))
    return members.select(*A, F.explode(F.array_compact(F.array(*parts))).alias("p")).select(*A, "p.*")


def member_digests(members: DataFrame) -> DataFrame:
    """Digest per archive and part."""
    return _sums(member_parts(members), [*A, "part", "header"]).withColumn("digest", _digest(F.col("header")))


def timetable_signature(digests: DataFrame) -> DataFrame:
    """Timetable and validity signature per archive.

    Agencies, stops and feed information take no part. Validity dates have a
    signature of their own.
    """
    def of(part: str) -> Column:
        return F.coalesce(F.max(F.when(F.col("part") == part, F.col("digest"))), F.lit(MISSING))

    timetable = [*CORE_MEMBERS, "calendar_patterns", "calendar_exceptions"]
    return digests.groupBy(*A).agg(
        F.sha2(F.concat_ws("\n", *[F.concat(F.lit(f"{p}:"), of(p)) for p in timetable]), 256)
        .alias("timetable_signature"),
        F.sha2(of("calendar_validity"), 256).alias("validity_signature"),
    )


def validity_signature(calendar: DataFrame) -> DataFrame:
    """Digest of service, start and end date per archive."""
    return table_digest(calendar, A, ["service_id", "start_date", "end_date"])
