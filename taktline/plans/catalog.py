"""Fetching: what to get next, and the books after a fetch. No network here."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame

from taktline.operators import catalog


def fetch_plan(
    registry: DataFrame, manifest: DataFrame, anchor: dt.date, depth: int = 0, mode: str = "current",
    all_listed: bool = False, only: DataFrame | None = None, listing: DataFrame | None = None,
) -> dict[str, DataFrame]:
    """Work list of archive versions, and the feeds left out with a reason.

    ``only`` limits the run to given feed pairs. A history run takes feeds
    whether or not they are valid on the anchor date.
    """
    feeds = registry if only is None else registry.join(only, catalog.FEED, "left_semi")
    excluded = catalog.excluded_feeds(feeds, anchor, mode, all_listed)
    wanted = feeds.join(excluded.select(*catalog.FEED), catalog.FEED, "left_anti")
    return {
        "worklist": catalog.worklist_skip_existing(wanted, manifest, depth, mode, listing),
        "gtfs_excluded_registry_feeds": excluded,
        "requested_feeds": wanted.select(*catalog.FEED),
    }


def record_fetch(
    manifest: DataFrame, fetched: DataFrame, coverage: DataFrame, requested: DataFrame, excluded: DataFrame,
    depth: int,
) -> dict[str, DataFrame]:
    """Manifest, history coverage and counts after a fetch."""
    return {
        "manifest": catalog.manifest_upsert(manifest, fetched),
        "gtfs_history_fetch_coverage": catalog.coverage_upsert(coverage, requested, depth) if depth else coverage,
        "run_counts": catalog.fetch_run_counts(fetched, requested, excluded),
    }


def recover_metadata(manifest: DataFrame, work: DataFrame, results: DataFrame) -> dict[str, DataFrame]:
    """Manifest and log after asking for the published file names."""
    return {
        "manifest": catalog.metadata_merge(manifest, results),
        "gtfs_history_metadata_recovery": catalog.metadata_recovery_log(work, results),
    }
