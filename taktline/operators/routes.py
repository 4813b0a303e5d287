"""Agencies, bus routes and the trips that run on them."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from taktline.constants import ARCHIVE_KEYS, SINGLE_AGENCY_ID
from taktline.functions import is_bus_route, strip

A = list(ARCHIVE_KEYS)


def _blank_to_empty(name: str):
    return F.coalesce(F.col(name), F.lit(""))


def archive_agency_ids(agency: DataFrame) -> DataFrame:
    """Per archive: agency rows and, if there is one id only, that id."""
    agency_id = _blank_to_empty("agency_id")
    return agency.groupBy(*A).agg(
        F.count("*").alias("agency_rows"),
        F.min(agency_id).alias("_low"),
        F.max(agency_id).alias("_high"),
    ).select(
        *A,
        "agency_rows",
        F.when((F.col("agency_rows") == 1) & (F.col("_low") == ""), F.lit(SINGLE_AGENCY_ID))
        .when(F.col("_low") == F.col("_high"), F.col("_low"))
        .alias("only_agency_id"),
    )


def single_agency_fill(agency: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """Fill a blank agency id where the archive has exactly one agency row."""
    ids = archive_agency_ids(agency) if ids is None else ids
    return agency.join(ids, A).withColumn(
        "agency_id",
        F.when(
            (_blank_to_empty("agency_id") == "") & (F.col("agency_rows") == 1),
            F.col("only_agency_id"),
        ).otherwise(_blank_to_empty("agency_id")),
    ).drop("only_agency_id")


def agency_names(agency: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """One row per agency id; the last source row wins."""
    filled = single_agency_fill(agency, ids)
    return filled.groupBy(*A, "agency_id").agg(
        F.max_by(F.struct("agency_name", "agency_url"), "row_ix").alias("_row")
    ).select(*A, "agency_id", "_row.agency_name", "_row.agency_url")


def bus_routes_only(routes: DataFrame, ids: DataFrame) -> DataFrame:
    """Bus routes of archives that have agencies, with the agency id filled."""
    bus = routes.where(is_bus_route(F.col("route_type")))
    return bus.join(ids, A).select(
        *A,
        _blank_to_empty("route_id").alias("route_id"),
        F.coalesce(
            F.nullif(_blank_to_empty("agency_id"), F.lit("")), F.col("only_agency_id"), F.lit("")
        ).alias("agency_id"),
        strip(F.col("route_type")).alias("route_type"),
        "row_ix",
    )


def route_lookup(bus_routes: DataFrame) -> DataFrame:
    """Agency of a route; the last bus row of a repeated route id wins."""
    return bus_routes.groupBy(*A, "route_id").agg(F.max_by("agency_id", "row_ix").alias("agency_id"))


def join_trips_routes(trips: DataFrame, bus_routes: DataFrame) -> DataFrame:
    """Trip rows that run on a bus route, with their agency. All rows stay."""
    return trips.withColumn("route_id", _blank_to_empty("route_id")).join(
        route_lookup(bus_routes), [*A, "route_id"]
    ).withColumn("service_id", _blank_to_empty("service_id"))


def trip_lookup(bus_trips: DataFrame) -> DataFrame:
    """One row per trip id: the last source row of a repeated id wins."""
    return bus_trips.groupBy(*A, "trip_id").agg(
        F.max_by(F.struct("agency_id", "service_id", "route_id"), "row_ix").alias("_row")
    ).select(*A, "trip_id", "_row.agency_id", "_row.service_id", "_row.route_id")


def feed_outcome(
    archives: DataFrame, agency: DataFrame, routes: DataFrame
) -> DataFrame:
    """Per archive: was it analysed, and if not, why."""
    agencies = agency.groupBy(*A).agg(F.count("*").alias("agency_count"))
    bus = routes.where(is_bus_route(F.col("route_type"))).groupBy(*A).agg(
        F.count_distinct("route_id").alias("bus_route_count")
    )
    return archives.select(*A).join(agencies, A, "left").join(bus, A, "left").select(
        *A,
        F.coalesce("agency_count", F.lit(0)).alias("agency_count"),
        F.coalesce("bus_route_count", F.lit(0)).alias("bus_route_count"),
        F.when(F.col("agency_count").isNull(), "agency_txt_missing")
        .when(F.col("bus_route_count").isNull(), "no_bus_route_type")
        .otherwise("bus_feed_analyzed")
        .alias("status"),
    )
