"""Match against the operator statistics and count what survives."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession, functions as F

from taktline.operators import funnel, links
from taktline.operators.matching import Matching
from taktline.sources.lists import approved_aliases
from taktline.sources.tables import completeness_without_source, empty_table
from taktline.schemas import LINKS_OPERATORS, LINKS_ROWS
from taktline.workspace import Lazy, Workspace

NO_COMMON = (
    "links_operator_id STRING, common_links_year STRING, common_permit_type STRING, "
    "transport_complete BOOLEAN, driver_complete BOOLEAN"
)
NO_MATCH = "operator_id STRING, match_class STRING, links_operator_id STRING, links_operator_name STRING"


def audit_run(
    spark: SparkSession, operators: DataFrame, history: DataFrame, supply: DataFrame | None,
    records: DataFrame | None, registry: DataFrame, aliases: DataFrame | None = None,
    workspace: Workspace | Lazy = Lazy(), blank_rule: str = "strict", current: dict[str, DataFrame] | None = None,
    anchor: dt.date | None = None, status: DataFrame | None = None,
) -> dict[str, DataFrame]:
    """``records`` is None when the statistics were not obtained; ``blank_rule``: see ``transport_complete``.

    ``current`` (results of ``current_service`` on ``anchor``) adds the gap and grain tables, ``status`` the outcome of
    each statistics file.
    """
    available = records is not None
    if available:
        rows = workspace.keep(links.links_rows(records), "links_rows")
        companies = workspace.keep(links.links_operator_rollup(rows), "links_operators").withColumn(
            "row_ix", F.struct("first_path", "first_file", "first_row")
        )
        completeness = links.field_completeness(records)
        common = links.common_year_permit(links.transport_complete(rows, blank_rule))
        matching = Matching(operators, companies, approved_aliases(aliases, spark), workspace)
        matched = matching.matched_operators()
    else:
        rows, companies = empty_table(spark, LINKS_ROWS), empty_table(spark, LINKS_OPERATORS)
        completeness = completeness_without_source(spark)
        common, matched = spark.createDataFrame([], NO_COMMON), spark.createDataFrame([], NO_MATCH)
        matching = Matching(operators, None)
    flags = workspace.keep(funnel.operator_flags(operators, matched, common, history), "flags")
    results = {
        "links_raw_rows": rows,
        "links_operator_metrics": companies,
        "field_completeness": completeness,
        "matched_operators": matched,
        "unmatched_gtfs": matching.unmatched_left(),
        "unmatched_links": matching.unmatched_right(),
        "match_summary": matching.match_summary(),
        "operator_funnel_detail": funnel.operator_detail(flags, available, tuple(operators.columns)),
        "funnel_summary": funnel.funnel(flags, available),
        "prefecture_summary": funnel.prefecture_summary(flags, available).withColumnRenamed(
            "full_complete", "full_complete_supply_stress_test"),
        "region_detail": funnel.region_detail(flags, registry, available=available, metrics=tuple(operators.columns)),
        "indicator_feasibility": funnel.indicator_feasibility(flags, supply, available),
        "verdict": funnel.verdict(flags, available),
    }
    if current is not None:
        counts = workspace.keep(funnel.audit_counts(
            registry, current["anchor_feed_selection"], current["gtfs_feed_metrics"], current["gtfs_agency_metrics"],
            operators, history), "audit_counts")
        results["data_gap_summary"] = funnel.data_gap_summary(counts, anchor)
        results["grain_summary"] = funnel.grain_summary(counts)
    if status is not None:
        results["links_file_status"] = status
    results["normalized_gtfs_operators"] = links.normalized_operators(operators)
    if available:
        results["normalized_links_rows"] = links.row_normalization(records)
        results["fuzzy_candidates"] = matching.fuzzy_candidates()
    return results
