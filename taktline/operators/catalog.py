"""Feed catalogue, archive manifest and the choice of an archive for a date."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, functions as F

from taktline.constants import ARCHIVE_KEYS, FEED_KEYS
from taktline.functions import selector_no
from taktline.sources.archives import file_name, path_key, same_file

A = list(ARCHIVE_KEYS)
FEED = list(FEED_KEYS)
OK = "200"
GONE = "404"


def _covers(start: Column, end: Column, anchor: Column) -> Column:
    return F.coalesce(anchor.between(start, end), F.lit(False))


def feed_active_status(registry: DataFrame, anchor: dt.date) -> DataFrame:
    """Is a feed valid on the anchor date, and why (not)."""
    day = F.lit(anchor)
    start, end = F.col("latest_feed_start_date"), F.col("latest_feed_end_date")
    stopped = F.coalesce("feed_is_discontinued", F.lit(False))
    reason = (
        F.when(stopped & F.col("feed_discontinued_date").isNull(), "discontinued_date_unknown")
        .when(stopped & (F.col("feed_discontinued_date") <= day), "discontinued_on_or_before_anchor")
        .when(start.isNull() | end.isNull(), "missing_validity_dates")
        .when(_covers(start, end, day), "valid_on_anchor_date")
        .otherwise("outside_anchor_date")
    )
    return registry.withColumn("reason", reason).withColumn(
        "active", F.col("reason") == "valid_on_anchor_date"
    )


def excluded_feeds(
    registry: DataFrame, anchor: dt.date, mode: str = "current", all_listed: bool = False
) -> DataFrame:
    """Feeds left out of a run; a history run and an all-listed run leave out none."""
    rated = feed_active_status(registry, anchor)
    keep_all = all_listed or mode == "history"
    return rated.where(F.lit(False) if keep_all else ~F.col("active")).select(
        *FEED, "reason", "latest_feed_start_date", "latest_feed_end_date", "feed_is_discontinued"
    )


def successful_archives(manifest: DataFrame, listing: DataFrame | None = None) -> DataFrame:
    """Rows fetched with status 200 whose file is in the listing of paths.

    Listings have absolute paths, often with a scheme; the manifest may have relative ones.
    """
    fetched = manifest.where(F.col("status") == OK)
    if listing is None:
        return fetched
    there = listing.where("path <> ''").select(path_key(F.col("path")).alias("_there")).withColumn("_there_name", file_name(F.col("_there")))
    own = fetched.where("path <> ''").withColumn("_key", path_key(F.col("path"))).withColumn("_name", file_name(F.col("_key")))
    same = same_file(F.col("_key"), F.col("_there"))
    return own.join(there, (F.col("_name") == F.col("_there_name")) & same, "left_semi").drop("_key", "_name")


def anchor_select(registry: DataFrame, versions: DataFrame, anchor: dt.date) -> DataFrame:
    """The newest archive of a feed that is valid on the anchor date.

    ``versions`` are successful archives with the validity window they state
    themselves. The ``current`` archive also counts where the window in the
    catalogue covers the date.
    """
    day = F.lit(anchor)
    stopped = F.coalesce("feed_is_discontinued", F.lit(False))
    ended = F.col("feed_discontinued_date")
    excluded = (
        F.when(stopped & ended.isNull(), "excluded_discontinued_date_unknown")
        .when(stopped & (ended <= day), "excluded_discontinued_on_or_before_anchor")
    )
    reg_start, reg_end = F.col("latest_feed_start_date"), F.col("latest_feed_end_date")
    own = _covers(F.col("validity_start"), F.col("validity_end"), day)
    listed = (F.col("version_selector") == "current") & _covers(reg_start, reg_end, day)
    rated = registry.withColumn("_excluded", excluded)
    windows = rated.where("_excluded IS NULL").select(*FEED, reg_start, reg_end)
    # The first two steps leave at most a few rows per feed to choose from.
    chosen = versions.select(*A, "validity_start", "validity_end", "row_ix").join(windows, FEED).where(
        own | listed
    ).groupBy(*FEED).agg(
        F.min_by(
            F.struct(
                F.col("version_selector").alias("selected_version_selector"),
                F.when(own, F.col("validity_start")).otherwise(reg_start).alias("validity_start"),
                F.when(own, F.col("validity_end")).otherwise(reg_end).alias("validity_end"),
                F.when(own, "archive_feed_info_window")
                .otherwise("registry_latest_window_feed_info_missing_or_noncovering")
                .alias("selection_basis"),
            ),
            F.struct(selector_no(F.col("version_selector")), F.col("row_ix")),
        ).alias("_s")
    )
    status = F.coalesce(
        "_excluded",
        F.when(F.col("_s").isNotNull(), "selected").otherwise("no_downloaded_archive_valid_on_anchor"),
    )
    return rated.join(chosen, FEED, "left").select(
        *FEED, "_s.selected_version_selector", status.alias("status"),
        reg_start.alias("registry_latest_start"), reg_end.alias("registry_latest_end"),
        "feed_is_discontinued", "feed_discontinued_date",
        "_s.validity_start", "_s.validity_end", "_s.selection_basis",
    )


def validity_mismatch(selection: DataFrame) -> DataFrame:
    """Selected feeds whose catalogue dates differ from the archive's own."""
    same = F.col("registry_latest_start").eqNullSafe(F.col("validity_start")) & F.col(
        "registry_latest_end"
    ).eqNullSafe(F.col("validity_end"))
    return selection.where((F.col("status") == "selected") & ~same)


def selector_counts(selection: DataFrame) -> DataFrame:
    """Selected archives per version selector."""
    return selection.where("status = 'selected'").groupBy("selected_version_selector").agg(
        F.count("*").alias("archives")
    )


# -- manifest -----------------------------------------------------------------


def worklist_skip_existing(
    feeds: DataFrame, manifest: DataFrame, depth: int, mode: str = "both",
    listing: DataFrame | None = None,
) -> DataFrame:
    """Versions still to fetch: not there yet and before the first known 404."""
    done = successful_archives(manifest, listing).select(*A).distinct()
    gone = manifest.where((F.col("status") == GONE) & F.col("version_selector").startswith("prev_")).groupBy(
        *FEED
    ).agg(F.min(selector_no(F.col("version_selector"))).alias("first_gone"))
    # The search depth is cut before it is expanded.
    last = F.least(F.lit(depth), F.col("first_gone") - 1)
    none = F.array().cast("array<int>")
    older = F.when(last >= 1, F.sequence(F.lit(1), last)).otherwise(none)
    numbers = {"current": F.array(F.lit(0)), "history": older, "both": F.concat(F.array(F.lit(0)), older)}[mode]
    todo = feeds.select(*FEED).join(gone, FEED, "left").select(*FEED, F.explode(numbers).alias("n"))
    selector = F.when(F.col("n") == 0, "current").otherwise(F.concat(F.lit("prev_"), F.col("n").cast("string")))
    return todo.select(*FEED, selector.alias("version_selector")).join(done, A, "left_anti")


def manifest_upsert(existing: DataFrame, fetched: DataFrame) -> DataFrame:
    """New rows replace rows of the same archive; all other rows stay."""
    kept = existing.join(fetched.select(*A).distinct(), A, "left_anti")
    return kept.unionByName(fetched, allowMissingColumns=True)


def coverage_upsert(existing: DataFrame, feeds: DataFrame, depth: int) -> DataFrame:
    """Deepest history ever asked for, per feed."""
    asked = feeds.select(*FEED, F.lit(depth).alias("_asked")).distinct()
    return existing.join(asked, FEED, "full").select(
        *FEED, F.greatest("requested_history_depth", "_asked").alias("requested_history_depth")
    )


def metadata_recovery_worklist(
    manifest: DataFrame, classified: DataFrame, listing: DataFrame | None = None
) -> DataFrame:
    """Older distinct generations whose published file name is unknown."""
    distinct = classified.where(
        F.col("classification").isin("latest_distinct_generation", "timetable_content_changed")
    ).select(*A)
    unknown = F.coalesce("content_disposition", F.lit("")) == ""
    return successful_archives(manifest, listing).where(
        F.col("version_selector").startswith("prev_") & unknown
    ).join(distinct, A, "left_semi")


METADATA = ("metadata_http_status", "metadata_retrieved_utc", "metadata_recovered_by", "metadata_error")


def metadata_merge(manifest: DataFrame, results: DataFrame) -> DataFrame:
    """Recovered columns overwrite; an empty file name does not."""
    new = results.select(
        *A, F.lit(True).alias("_hit"),
        F.nullif("content_disposition", F.lit("")).alias("_cd"),
        *[F.col(c).alias(f"_{c}") for c in METADATA],
    )
    present = set(manifest.columns)
    merged = {
        c: F.when(F.col("_hit"), F.col(f"_{c}")).otherwise(F.col(c) if c in present else F.lit(None))
        for c in METADATA
    }
    merged["content_disposition"] = F.coalesce("_cd", "content_disposition")
    return manifest.join(new, A, "left").withColumns(merged).drop("_hit", "_cd", *[f"_{c}" for c in METADATA])


def metadata_recovery_log(work: DataFrame, results: DataFrame) -> DataFrame:
    """One row per request with its outcome."""
    answers = results.select(
        *A, "metadata_http_status", "content_disposition",
        F.col("metadata_retrieved_utc").alias("retrieved_utc"), F.col("metadata_error").alias("error"),
    )
    return work.select(*A, F.col("source_url").alias("url"), "path", "sha256").join(answers, A)


def size_reconciliation(responses: DataFrame) -> DataFrame:
    """Local size against the size a server states for the same archive."""
    status = F.col("metadata_http_status")
    total = F.regexp_extract(F.coalesce("content_range", F.lit("")), r"/(\d+)\s*$", 1).try_cast("bigint")
    length = F.nullif("content_length", F.lit("")).try_cast("bigint")
    return responses.withColumn(
        "size_status",
        F.when(status.isNull() | ~status.isin("200", "206"), "bad_status")
        .when(F.coalesce("content_disposition", F.lit("")) == "", "no_disposition")
        .when((status == "206") & (total != F.col("bytes")), "mismatch")
        .when((status == "200") & (length != F.col("bytes")), "mismatch")
        .otherwise("ok"),
    )


def fetch_run_counts(records: DataFrame, feeds: DataFrame, excluded: DataFrame) -> DataFrame:
    """One row: what a fetch run asked for and got."""
    tagged = (
        records.select("version_selector", "status", F.lit("record").alias("kind"))
        .unionByName(feeds.select(F.lit("").alias("version_selector"), F.lit("").alias("status"), F.lit("feed").alias("kind")))
        .unionByName(excluded.select(F.lit("").alias("version_selector"), F.lit("").alias("status"), F.lit("excluded").alias("kind")))
    )
    record = F.col("kind") == "record"
    return tagged.agg(
        F.count_if(F.col("kind") == "feed").alias("requested_feeds"),
        F.count_if(record).alias("records_written"),
        F.count_if(record & (F.col("status") == OK)).alias("zip_success"),
        F.count_if(record & F.col("version_selector").startswith("prev_") & (F.col("status") != OK))
        .alias("history_empty_or_failed"),
        F.count_if(F.col("kind") == "excluded").alias("excluded_from_current"),
    )
