"""Results of a run as files, counted while they are written."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, Observation, SparkSession, functions as F

from taktline.sources.tables import write_run_metadata


def write_results(results: dict[str, DataFrame], folder: str) -> dict[str, int]:
    """Each result as Parquet below ``folder``, and its number of rows.

    The rows are counted in the job that writes them; no table is read again for that.
    """
    counts = {}
    for name, table in results.items():
        seen = Observation()
        table.observe(seen, F.count(F.lit(1)).alias("rows")).write.mode("overwrite").parquet(f"{folder}/{name}")
        counts[name] = seen.get["rows"]
    return counts


def write_current(spark: SparkSession, results: dict[str, DataFrame], anchor: dt.date, folder: str) -> None:
    """Results of ``current_service``, with its metadata as JSON made of the rows that were written.

    Only the archives per selector are grouped, from the selection that has been written.
    """
    tables = {name: table for name, table in results.items() if name != "run_metadata"}
    feeds, analysed = tables["gtfs_feed_metrics"], Observation()
    tables["gtfs_feed_metrics"] = feeds.observe(analysed, F.count_if(F.col("status") == "bus_feed_analyzed").alias("n"))
    counts = write_results(tables, folder)
    selected = (
        spark.read.parquet(f"{folder}/anchor_feed_selection").where("status = 'selected'")
        .groupBy(F.col("selected_version_selector").alias("name")).agg(F.count("*").alias("n")))
    total = F.coalesce(F.sum("n"), F.lit(0))
    write_run_metadata(selected.agg(
        F.lit(str(anchor)).alias("anchor_date"),
        total.alias("selected_anchor_feed_archives"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", "n")))).alias("selected_archive_versions"),
        F.lit(counts["gtfs_agency_metrics"]).alias("bus_agency_rows"),
        F.lit(counts["gtfs_operator_metrics"]).alias("gtfs_bus_operator_entities"),
        (total - F.lit(analysed.get["n"])).alias("excluded_feeds"),
        F.lit(counts["gtfs_analysis_errors"]).alias("errors"),
        F.lit("3, 11, 700-799").alias("route_type_rule"),
    ), f"{folder}/run_metadata")
