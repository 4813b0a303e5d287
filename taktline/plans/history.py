"""History: timetable generations, operator history, year-over-year supply."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from taktline.constants import ARCHIVE_KEYS
from taktline.functions import disposition_filename, effective_date, upload_datetime
from taktline.operators import catalog, digest, history
from taktline.operators.service import ServiceModel, Timetable, operator_component_feeds
from taktline.plans.current import feed_dimension, restrict, typed_timetable
from taktline.sources.archives import split_errors
from taktline.workspace import Lazy, Workspace

A = list(ARCHIVE_KEYS)


def signed_versions(
    manifest: DataFrame, members: DataFrame, listing: DataFrame | None = None, names: DataFrame | None = None
) -> DataFrame:
    """Successful archives with signatures, the dates in their file names and the names of their members.

    ``names``: archive keys and ``gtfs_members``. Without it, and where an archive has no signature, the names are NULL.
    """
    signatures = digest.timetable_signature(digest.member_digests(members))
    name = disposition_filename(F.col("content_disposition"), F.col("path"))
    versions = catalog.successful_archives(manifest, listing).join(signatures, A, "left").withColumns(
        {"upload_utc": upload_datetime(name), "effective_start": effective_date(name)}
    )
    if names is None:
        return versions.withColumn("gtfs_members", F.lit(None).cast("string"))
    one = names.groupBy(*A).agg(F.max("gtfs_members").alias("gtfs_members"))
    return versions.join(one, A, "left").withColumn("gtfs_members", F.expr("if(timetable_signature IS NOT NULL, gtfs_members, NULL)"))


def version_metrics(
    classified: DataFrame, timetable: Timetable, feeds: DataFrame, workspace: Workspace | Lazy = Lazy()
) -> DataFrame:
    """Agency metrics of every dated generation, each at its own date.

    One job for all generations: the anchor date is a column of the archive. What a step shuffled leaves the disks before
    the next one begins.
    """
    archives = classified.where(
        "distinct_generation_number IS NOT NULL AND effective_start IS NOT NULL"
    ).select(*A, F.col("effective_start").alias("anchor_date"), "timetable_signature")
    with workspace.compact():
        generations = workspace.keep(archives, "generations")
        model = ServiceModel(restrict(timetable, generations, workspace), workspace)
        return model.agency_metrics(feeds).withColumnRenamed("anchor_date", "generation_effective_start")


def history_run(
    registry: DataFrame, manifest: DataFrame, coverage: DataFrame, members: DataFrame,
    agency_metrics: DataFrame, workspace: Workspace | Lazy = Lazy(), listing: DataFrame | None = None,
    operators: DataFrame | None = None, names: DataFrame | None = None,
) -> dict[str, DataFrame]:
    """All history results; ``agency_metrics`` are those of the current run.

    ``operators`` (those of the current run) give names, prefectures and feeds
    to the operator tables; ``names`` (``members.member_names``) gives ``gtfs_members``. An archive that could not be read is a version with ``analysis_error`` and
    is left out of everything else.
    """
    members, errors = split_errors(members)
    errors = workspace.keep(errors.select(*A, "path", "error"), "version_errors")
    signed = signed_versions(manifest, members, listing, names).join(errors.select(*A, "error"), A, "left")
    classified = workspace.keep(history.version_classify(signed), "versions")
    timetable = typed_timetable(members, classified)
    metrics = workspace.keep(
        version_metrics(classified, timetable, feed_dimension(registry), workspace), "version_metrics"
    )
    components = workspace.keep(operator_component_feeds(agency_metrics), "component_feeds")
    feed_states = workspace.keep(history.feed_history(classified), "feed_states")
    summary = history.operator_history(
        components, metrics, history.version_representative(classified), feed_states,
        history.history_exhaustion(manifest, coverage, listing),
    )
    supply = history.supply_yoy(components, history.yoy_interval_pair(metrics))
    if operators is not None:
        names = operators.select("operator_id", "agency_name", "prefectures", "feed_ids")
        summary = names.join(summary, "operator_id", "right")
        supply = names.drop("feed_ids").join(supply, "operator_id", "right")
    return {
        "gtfs_history_versions": classified,
        "gtfs_history_feeds": feed_states,
        "gtfs_version_metrics": metrics,
        "gtfs_history_summary": summary,
        "gtfs_supply_yoy": supply,
        "metadata_recovery_worklist": catalog.metadata_recovery_worklist(manifest, classified),
    }
