"""Schemas of the input tables; every cell arrives as text."""

from __future__ import annotations

from pyspark.sql.types import (
    ArrayType, BooleanType, IntegerType, LongType, MapType, StringType, StructField, StructType,
)


def strings(*names: str) -> list[StructField]:
    return [StructField(n, StringType()) for n in names]


REGISTRY_FEED = StructType(
    [
        *strings("organization_id", "organization_name", "feed_id", "feed_name"),
        StructField("feed_pref_id", IntegerType()),
        *strings("latest_feed_start_date", "latest_feed_end_date"),
        StructField("feed_is_discontinued", BooleanType()),
        *strings("feed_discontinued_date"),
        *strings(
            "organization_email", "feed_memo", "feed_src_gtfs_current_url", "feed_src_gtfs_next_url",
            "feed_src_gtfs_web_url", "organization_web_url",
        ),
    ]
)
REGISTRY_ENVELOPE = StructType(
    [StructField("code", IntegerType()), StructField("body", ArrayType(REGISTRY_FEED))]
)

# One row per CSV record of an archive; row NULL: the member exists.
MEMBER = StructType(
    [
        *strings("path", "member"),
        StructField("header", ArrayType(StringType())),
        StructField("row_ix", LongType()),
        StructField("row", MapType(StringType(), StringType())),
        *strings("error"),
        StructField("whole", BooleanType()),
    ]
)

# Types of the measured tables, so that a run without the source writes tables of one type with all others.
LINKS_ROWS = StructType(
    [
        *strings("path", "source_file"),
        StructField("source_row", LongType()),
        *strings(
            "dataset", "operator_name", "operator_number", "year", "permit_type", "prefecture_address",
            "passenger_count", "vehicle_count", "revenue", "driver_count",
        ),
        StructField("driver_valued", BooleanType()),
        *strings("links_operator_id"),
    ]
)
LINKS_OPERATORS = StructType(
    [
        *strings("links_operator_id", "operator_name", "operator_number", "prefecture_address", "years", "datasets"),
        StructField("source_rows", LongType()),
        StructField("has_driver_count", BooleanType()),
        StructField("has_transport_performance", BooleanType()),
        StructField("has_business_overview", BooleanType()),
        *strings("first_path", "first_file"),
        StructField("first_row", LongType()),
    ]
)
FETCH_STATUS = StructType(
    strings("source", "url", "method", "status", "retrieved_utc", "bytes", "sha256", "reason")
)
MANIFEST = StructType(
    [
        *strings("organization_id", "feed_id", "version_selector", "source_url", "status", "path"),
        StructField("bytes", LongType()),
        *strings("sha256", "content_disposition", "retrieved_utc", "error"),
    ]
)
COVERAGE = StructType([*strings("organization_id", "feed_id"), StructField("requested_history_depth", IntegerType())])
