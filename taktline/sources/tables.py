"""CSV tables of text, results, logs and run metadata."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructField, StructType

from taktline.constants import FIELD_TERMS
from taktline.schemas import FETCH_STATUS

BOM = "﻿"


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """A table whose cells all stay text; a byte-order mark is not part of a name."""
    df = spark.read.csv(path, header=True, inferSchema=False, multiLine=True, escape='"')
    return df.toDF(*[c.removeprefix(BOM).strip('"') for c in df.columns]).fillna("")


def union_tables(tables: list[DataFrame]) -> DataFrame:
    """Rows of several tables under the union of their columns."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)


def _parsed(df: DataFrame, field: StructField):
    """A column in the type of the field; text that isn't such a value is NULL."""
    same = isinstance(df.schema[field.name].dataType, type(field.dataType))
    return F.col(field.name) if same else F.col(field.name).try_cast(field.dataType)


def conform(df: DataFrame, schema: StructType | None) -> DataFrame:
    """Columns of a fixed schema: others are dropped, missing ones are blank."""
    if schema is None:
        return df
    return df.select(
        *[(_parsed(df, f) if f.name in df.columns else F.lit(None).cast(f.dataType)).alias(f.name) for f in schema]
    )


def write_table(df: DataFrame, path: str, schema: StructType | None = None, csv: bool = False) -> None:
    """Save a result; Parquet unless CSV is asked for."""
    writer = conform(df, schema).write.mode("overwrite")
    if csv:
        writer.csv(path, header=True)
    else:
        writer.parquet(path)


def empty_table(spark: SparkSession, schema: StructType) -> DataFrame:
    """A table with a header only."""
    return spark.createDataFrame([], schema)


def completeness_without_source(spark: SparkSession) -> DataFrame:
    """One row per field that says its counts are unknown, not zero."""
    blank = F.lit(None).cast("bigint")
    return spark.range(1).select(
        F.lit("not_acquired").alias("dataset"), F.lit("").alias("source_file"), F.lit("").alias("year"),
        F.explode(F.array(*[F.lit(f) for f in FIELD_TERMS])).alias("field"), F.lit("").alias("columns"),
        blank.alias("rows_total"), blank.alias("rows_nonblank"), blank.alias("unique_operator_ids_nonblank"),
        F.lit("not_evaluable_source_not_retrieved").alias("status"),
        F.lit("No source rows were acquired; blank counts are unknown, not zero.").alias("grain_note"),
    )


def fetch_status_log(spark: SparkSession, csv_path: str | None, json_path: str | None) -> DataFrame:
    """Acquisition log from its CSV and its JSON form."""
    parts = []
    if csv_path:
        parts.append(read_csv(spark, csv_path))
    if json_path:
        parts.append(spark.read.schema(FETCH_STATUS).json(json_path, multiLine=True))
    return union_tables(parts)


def status_counts(log: DataFrame) -> DataFrame:
    """Attempts per status."""
    return log.groupBy("status").agg(F.count("*").alias("attempts"))


def run_metadata(
    anchor, selection: DataFrame, feed_metrics: DataFrame, agency_metrics: DataFrame,
    operators: DataFrame, errors: DataFrame,
) -> DataFrame:
    """One row about a run: archives per selector, rows, entities, exclusions.

    Each input is reduced to a few rows first; there are as many selectors as
    archive versions of a feed.
    """
    selected = selection.where("status = 'selected'")
    per_selector = selected.groupBy(F.col("selected_version_selector").alias("name")).agg(F.count("*").alias("n"))

    def one(df: DataFrame, name: str, condition=None) -> DataFrame:
        counted = F.count("*") if condition is None else F.count_if(condition)
        return df.agg(counted.alias("n")).select(F.lit(name).alias("kind"), F.lit("").alias("name"), "n")

    parts = union_tables([
        per_selector.select(F.lit("selector").alias("kind"), "name", "n"),
        one(agency_metrics, "agencies"), one(operators, "operators"), one(errors, "errors"),
        one(feed_metrics, "analysed", F.col("status") == "bus_feed_analyzed"),
    ])

    def total(kind: str):
        return F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col("n"))), F.lit(0))

    selectors = F.array_sort(
        F.collect_list(F.when(F.col("kind") == "selector", F.struct("name", "n")))
    )
    return parts.agg(
        F.lit(str(anchor)).alias("anchor_date"),
        total("selector").alias("selected_anchor_feed_archives"),
        F.map_from_entries(selectors).alias("selected_archive_versions"),
        total("agencies").alias("bus_agency_rows"),
        total("operators").alias("gtfs_bus_operator_entities"),
        (total("selector") - total("analysed")).alias("excluded_feeds"),
        total("errors").alias("errors"),
        F.lit("3, 11, 700-799").alias("route_type_rule"),
    )


def write_run_metadata(metadata: DataFrame, path: str) -> None:
    metadata.write.mode("overwrite").json(path)
