"""Small reviewed lists: aliases and feed pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from taktline.functions import strip
from taktline.schemas import COVERAGE, MANIFEST
from taktline.sources.csv_ranges import RANGE_BYTES, CsvText
from taktline.sources.tables import conform, read_csv
from taktline.workspace import Workspace

COMPRESSED = r"(?i)\.(gz|gzip|bz2|deflate|lz4|snappy|zst|zstd|xz)$"

ALIAS_SCHEMA = StructType(
    [
        *[
            StructField(c, StringType())
            for c in ("operator_id", "links_operator_id", "evidence", "location_validation", "review_status")
        ],
        StructField("row_ix", LongType()),
    ]
)


def approved_aliases(aliases: DataFrame | None, spark: SparkSession | None = None) -> DataFrame:
    """Aliases a reviewer approved with evidence; an absent list has none."""
    if aliases is None:
        return spark.createDataFrame([], ALIAS_SCHEMA)
    return aliases.where(
        (F.lower("review_status") == "approved")
        & (F.coalesce("evidence", F.lit("")) != "")
        & (F.coalesce("location_validation", F.lit("")) != "")
    )


def parse_feed_pairs(lines: DataFrame) -> DataFrame:
    """``org,feed`` per line; other lines are skipped, repeats count once."""
    cells = F.split("value", ",", 2)
    return lines.where(F.size(cells) == 2).select(
        strip(cells[0]).alias("organization_id"), strip(cells[1]).alias("feed_id")
    ).distinct()


def read_feed_pairs(spark: SparkSession, path: str) -> DataFrame:
    return parse_feed_pairs(spark.read.text(path))


def feed_pair_lines(agency_metrics: DataFrame) -> DataFrame:
    """Sorted lines of the feed pairs that have a bus agency."""
    pairs = agency_metrics.select("organization_id", "feed_id").distinct()
    return pairs.orderBy("organization_id", "feed_id").select(
        F.concat_ws(",", "organization_id", "feed_id").alias("value")
    )


def write_feed_pairs(agency_metrics: DataFrame, path: str) -> None:
    feed_pair_lines(agency_metrics).write.mode("overwrite").text(path)


def read_numbered(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """A CSV table with ``row_ix``, the order of its rows, from 0 through all files by name.

    Cells may hold line feeds, so that records are found in byte ranges first; Spark then parses them one by one.
    Compressed files cannot be cut: one task reads one of these, and numbers only differ between them.
    """
    files = spark.read.format("binaryFile").load(path).select("path", "length")
    if files.where(F.col("path").rlike(COMPRESSED)).limit(1).count():
        return read_csv(spark, path).withColumn("row_ix", F.monotonically_increasing_id())
    named = read_csv(spark, path).columns
    cells = ", ".join(f"c{i} STRING" for i in range(len(named)))
    records = CsvText(files, Workspace(spark), range_bytes).numbered()
    parsed = records.select(F.from_csv("value", cells, {"escape": '"', "multiLine": "true"}).alias("cells"), "row_ix")
    return parsed.select("cells.*", "row_ix").toDF(*named, "row_ix").fillna("", [f"`{c}`" for c in named])


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """The manifest of fetched archives, in its order."""
    return conform(read_numbered(spark, path), StructType([*MANIFEST.fields, StructField("row_ix", LongType())]))


def read_aliases(spark: SparkSession, path: str) -> DataFrame:
    """Reviewed aliases, in their order."""
    return conform(read_numbered(spark, path), ALIAS_SCHEMA)


def read_coverage(spark: SparkSession, path: str) -> DataFrame:
    """How many old versions were asked for, per feed."""
    return conform(read_csv(spark, path), COVERAGE)
