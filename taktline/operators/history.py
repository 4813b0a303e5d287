"""Timetable generations of a feed and the history of an operator."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from taktline.constants import FEED_KEYS, HISTORY_DAYS, YOY_BAND_DAYS, YOY_GAP_DAYS
from taktline.functions import pct_change, selector_no
from taktline.operators.ordering import running_number

FEED = list(FEED_KEYS)
SIGNED = [*FEED, "timetable_signature"]
SELECTORS_PER_BLOCK = 256


def version_classify(versions: DataFrame) -> DataFrame:
    """Generation number of each archive version, newest first.

    The first holder of a signature is a generation; any later holder repeats
    it. A version without a signature could not be analysed.
    """
    ranked = versions.withColumn("_no", selector_no(F.col("version_selector")))
    heads = ranked.where("timetable_signature IS NOT NULL").groupBy(*SIGNED).agg(
        F.min(
            F.struct(
                "_no", "row_ix", F.col("validity_signature").alias("validity"), F.col("sha256").alias("sha")
            )
        ).alias("_head")
    ).select(*SIGNED, F.col("_head._no").alias("_head_no"), F.col("_head.row_ix").alias("_head_ix"),
             F.col("_head.validity").alias("_head_validity"), F.col("_head.sha").alias("_head_sha"))
    numbered = running_number(
        heads, FEED, [F.col("_head_no"), F.col("_head_ix")],
        F.expr(f"_head_no div {SELECTORS_PER_BLOCK}"), "_generation",
    )
    is_head = (F.col("_no") == F.col("_head_no")) & (F.col("row_ix") == F.col("_head_ix"))
    label = (
        F.when(F.col("timetable_signature").isNull(), "analysis_error")
        .when(is_head & (F.col("_generation") == 1), "latest_distinct_generation")
        .when(is_head, "timetable_content_changed")
        .when(~F.col("validity_signature").eqNullSafe(F.col("_head_validity")), "validity_window_only")
        .when(~F.col("sha256").eqNullSafe(F.col("_head_sha")), "same_timetable_reupload_or_metadata_only")
        .otherwise("byte_identical_duplicate")
    )
    return ranked.join(numbered, SIGNED, "left").select(
        *versions.columns,
        F.when(is_head, F.col("_generation")).alias("distinct_generation_number"),
        label.alias("classification"),
    )


def _long_enough(span: Column, years: int) -> Column:
    return F.coalesce(span >= HISTORY_DAYS[years], F.lit(False))


def feed_history(classified: DataFrame) -> DataFrame:
    """Generations and time span per feed."""
    head = F.col("distinct_generation_number").isNotNull()
    current = head & (F.col("version_selector") == "current")
    old = head & (F.col("version_selector") != "current")
    history = classified.groupBy(*FEED).agg(
        F.count_if(head).alias("distinct_timetable_generations"),
        F.count_if(old).alias("distinct_old_generations"),
        F.count("*").alias("archive_versions_downloaded"),
        F.max(F.when(current, F.col("upload_utc"))).alias("latest_upload_utc"),
        F.min(F.when(old, F.col("upload_utc"))).alias("oldest_distinct_old_upload_utc"),
        F.max(F.when(current, F.col("effective_start"))).alias("current_generation_effective_start"),
        F.min(F.when(old, F.col("effective_start"))).alias("oldest_distinct_generation_effective_start"),
    )
    span = F.date_diff("current_generation_effective_start", "oldest_distinct_generation_effective_start")
    seconds = F.unix_seconds("latest_upload_utc") - F.unix_seconds("oldest_distinct_old_upload_utc")
    return history.withColumns(
        {"history_span_days": span, "archive_publication_span_days": F.floor(seconds / 86400).cast("int")}
    ).select(
        "*",
        (F.col("distinct_timetable_generations") >= 2).alias("has_2plus_generations"),
        *[_long_enough(F.col("history_span_days"), y).alias(f"history_{y}plus_year") for y in HISTORY_DAYS],
        F.when(F.col("history_span_days").isNotNull(), "measured")
        .otherwise("effective_schedule_date_unavailable").alias("date_evidence_status"),
        F.lit("measured").alias("history_status"),
    )


def version_representative(classified: DataFrame) -> DataFrame:
    """The version that dates a signature: the current one, else the earliest."""
    order = F.struct(
        F.coalesce(F.col("version_selector") != "current", F.lit(True)),
        F.col("effective_start").isNull(), "effective_start",
        selector_no(F.col("version_selector")), "row_ix",
    )
    return classified.where("timetable_signature IS NOT NULL").groupBy(*SIGNED).agg(
        F.min_by(F.struct("version_selector", "effective_start"), order).alias("_v")
    ).select(*SIGNED, "_v.version_selector", "_v.effective_start")


def history_exhaustion(manifest: DataFrame, coverage: DataFrame, listing: DataFrame | None = None) -> DataFrame:
    """Did the search for old versions reach the end, a cap or an error.

    With a ``listing`` of paths only versions whose file is there count as deep.
    """
    status = F.col("status")
    if listing is None:
        manifest = manifest.withColumn("_there", F.lit(True))
    else:
        there = listing.select("path").distinct().withColumn("_there", F.lit(True))
        manifest = manifest.join(there, "path", "left")
    older = manifest.where(F.col("version_selector").startswith("prev_")).groupBy(*FEED).agg(
        F.bool_or(status == "404").alias("terminal_404"),
        F.max(F.when((status == "200") & F.col("_there"), selector_no(F.col("version_selector")))).alias("deepest_version"),
        F.bool_or(~status.isin("200", "404")).alias("api_error"),
    )
    depth = F.coalesce("requested_history_depth", F.lit(0))
    capped = (depth > 0) & (F.coalesce("deepest_version", F.lit(0)) >= depth) & ~F.col("terminal_404")
    return older.join(coverage.select(*FEED, "requested_history_depth"), FEED, "left").select(
        *FEED, "terminal_404", "deepest_version", "api_error", capped.alias("depth_capped")
    )


def _per_operator_feed(version_metrics: DataFrame, representatives: DataFrame) -> DataFrame:
    """Generations in which an operator appears, per component feed."""
    by_signature = version_metrics.groupBy("operator_id", *SIGNED).agg(
        F.bool_or(F.col("version_selector") == "current").alias("is_current")
    )
    dated = by_signature.join(representatives.select(*SIGNED, "effective_start"), SIGNED, "left")
    return dated.groupBy("operator_id", *FEED).agg(
        F.count("*").alias("generations"),
        F.bool_or("is_current").alias("current_present"),
        F.max(F.when(F.col("is_current"), F.col("effective_start"))).alias("latest_start"),
        F.min(F.when(~F.col("is_current"), F.col("effective_start"))).alias("oldest_start"),
    )


def operator_history(
    component_feeds: DataFrame,
    version_metrics: DataFrame,
    representatives: DataFrame,
    feed_states: DataFrame,
    exhaustion: DataFrame,
) -> DataFrame:
    """History of an operator over all its component feeds.

    A flag is True or False only where that is known; otherwise it is NULL.
    ``component_feeds``: operator_id, organization_id, feed_id, one row each.
    """
    no = F.lit(False)
    components = (
        component_feeds.join(_per_operator_feed(version_metrics, representatives), ["operator_id", *FEED], "left")
        .join(feed_states.select(*FEED, "distinct_timetable_generations"), FEED, "left")
        .join(exhaustion.select(*FEED, "terminal_404", "api_error", "depth_capped"), FEED, "left")
    )
    generations = F.coalesce("generations", F.lit(0))
    span = F.date_diff("latest_start", "oldest_start")
    everywhere = F.coalesce(
        (F.col("distinct_timetable_generations") > 0) & (generations == F.col("distinct_timetable_generations")), no
    )
    facts = components.groupBy("operator_id").agg(
        F.count("*").alias("current_feed_count"),
        F.bool_and(F.coalesce("current_present", no)).alias("all_current"),
        F.bool_and(everywhere).alias("_everywhere"),
        F.min(generations).alias("min_generations"),
        F.max(generations).alias("_max_generations"),
        F.count(span).alias("_spans"),
        F.min(span).alias("min_span"),
        F.bool_and(F.coalesce("terminal_404", no)).alias("exhausted"),
        F.bool_or(F.coalesce("depth_capped", no)).alias("capped"),
        F.bool_or(F.coalesce("api_error", no)).alias("_api_error"),
    ).withColumn("stable", F.col("all_current") & F.col("_everywhere")).withColumn(
        "absence_known", F.col("stable") & F.col("exhausted") & ~F.col("_api_error")
    )
    absent = F.when(F.col("absence_known"), False)

    def years(n: int) -> Column:
        met = (F.col("_spans") == F.col("current_feed_count")) & (F.col("min_span") >= HISTORY_DAYS[n])
        return F.when(F.col("stable"), F.when(met, True).otherwise(absent)).alias(f"years_{n}plus_all_feeds")

    one_only = (F.col("min_generations") == 1) & (F.col("_max_generations") == 1)
    status = (
        F.when(F.col("_api_error"), "history_api_error")
        .when(F.col("capped"), "depth_cap_reached")
        .when(~F.col("exhausted"), "history_exhaustion_unconfirmed")
        .when(F.col("all_current") & ~F.col("stable"), "agency_identity_not_stable_across_generations")
        .when(F.col("stable"), "measured_same_agency_across_all_feeds")
        .otherwise("current_agency_not_confirmed_in_all_component_feeds")
    )
    return facts.select(
        "operator_id", "current_feed_count",
        F.col("all_current").alias("agency_present_current_in_all_component_feeds"),
        F.col("stable").alias("agency_identity_present_in_all_distinct_feed_generations"),
        F.col("min_generations").alias("distinct_generations_min_across_feeds"),
        F.when(F.col("absence_known") & one_only, True).otherwise(absent).alias("current_only_all_feeds"),
        F.when(F.col("stable") & (F.col("min_generations") >= 2), True).otherwise(absent)
        .alias("generations_2plus_all_feeds"),
        *[years(n) for n in HISTORY_DAYS],
        F.col("min_span").alias("minimum_component_history_span_days"),
        F.col("exhausted").alias("all_component_feeds_history_exhausted"),
        F.col("capped").alias("history_depth_cap_reached"),
        status.alias("history_status"),
    )


def operator_history_simple(component_feeds: DataFrame, feed_states: DataFrame) -> DataFrame:
    """First view of the history that ignores which agencies an archive holds."""
    generations = F.col("distinct_timetable_generations")
    facts = component_feeds.join(feed_states, FEED, "left").groupBy("operator_id").agg(
        F.count("*").alias("current_feed_count"),
        F.count(generations).alias("history_feed_rows_found"),
        F.min(generations).alias("distinct_generations_min_across_feeds"),
        F.max(generations).alias("_max"),
        *[F.bool_and(F.coalesce(f"history_{y}plus_year", F.lit(False))).alias(f"_y{y}") for y in HISTORY_DAYS],
        F.min("history_span_days").alias("minimum_component_history_span_days"),
    ).withColumn("all_component_feeds_measured", F.col("history_feed_rows_found") == F.col("current_feed_count"))
    measured = F.col("all_component_feeds_measured")
    low = F.coalesce("distinct_generations_min_across_feeds", F.lit(0))
    return facts.select(
        "operator_id", "current_feed_count", "history_feed_rows_found", "all_component_feeds_measured",
        "distinct_generations_min_across_feeds",
        (measured & (low == 1) & (F.coalesce("_max", F.lit(0)) == 1)).alias("current_only_all_feeds"),
        (measured & (low >= 2)).alias("generations_2plus_all_feeds"),
        *[(measured & F.col(f"_y{y}")).alias(f"years_{y}plus_all_feeds") for y in HISTORY_DAYS],
        "minimum_component_history_span_days",
        F.when(measured, "measured").otherwise("incomplete_component_feed_history").alias("history_status"),
    )


def _generation_supply(version_metrics: DataFrame) -> DataFrame:
    return version_metrics.where("generation_effective_start IS NOT NULL").groupBy("operator_id", *SIGNED).agg(
        F.bool_or(F.col("version_selector") == "current").alias("is_current"),
        F.min("generation_effective_start").alias("effective"),
        F.sum("weekday_trips_per_day_avg").alias("trips"),
        F.sum("weekday_trip_hours_per_day_approx").alias("hours"),
        F.sum("weekday_km_per_day_straight_line_approx").alias("km"),
    )


def yoy_interval_pair(
    version_metrics: DataFrame, gap_days: tuple[int, int] = YOY_GAP_DAYS
) -> DataFrame:
    """Newest current generation and the old one closest to a year before it."""
    supply = _generation_supply(version_metrics)
    values = ["effective", "trips", "hours", "km"]
    component = ["operator_id", *FEED]
    now = supply.where("is_current").groupBy(*component).agg(
        F.max_by(F.struct(*values), F.struct("effective", "timetable_signature")).alias("now")
    )
    then = supply.where("NOT is_current AND trips IS NOT NULL").select(
        *component, "timetable_signature", F.struct(*values).alias("then")
    )
    gap = F.date_diff(F.col("now.effective"), F.col("then.effective"))
    pairs = then.join(now, component).where(F.col("now.trips").isNotNull() & gap.between(*gap_days))
    best = pairs.groupBy(*component).agg(
        F.min_by(
            F.struct("now", "then", gap.alias("gap_days")),
            F.struct(F.abs(gap - gap_days[0]), "timetable_signature"),
        ).alias("_p")
    )
    return best.select(
        *component, F.col("_p.gap_days").alias("gap_days"),
        *[F.col(f"_p.then.{c}").alias(f"old_{c}") for c in values],
        *[F.col(f"_p.now.{c}").alias(f"current_{c}") for c in values],
    )


def supply_yoy(
    component_feeds: DataFrame, pairs: DataFrame, band_days: int = YOY_BAND_DAYS
) -> DataFrame:
    """Supply of a year before and now, where every component feed has a pair."""
    metrics = ("trips", "hours", "km")

    def total(column: str) -> Column:
        # Unknown as soon as one component is unknown.
        return F.when(F.count(column) == F.count("gap_days"), F.sum(column)).alias(column)

    facts = component_feeds.join(pairs, ["operator_id", *FEED], "left").groupBy("operator_id").agg(
        F.count("*").alias("component_feed_count"),
        F.count("gap_days").alias("comparable_component_feed_count"),
        *[f("old_effective").alias(f"_old_{n}") for n, f in (("min", F.min), ("max", F.max))],
        *[f("current_effective").alias(f"_now_{n}") for n, f in (("min", F.min), ("max", F.max))],
        *[total(f"{w}_{m}") for m in metrics for w in ("old", "current")],
    )
    complete = (F.col("comparable_component_feed_count") == F.col("component_feed_count")) & (
        F.date_diff("_old_max", "_old_min") <= band_days
    )
    known = F.col("gtfs_supply_yoy_computable")
    names = {
        "trips": "weekday_trips", "hours": "weekday_trip_hours", "km": "weekday_straight_line_km",
    }
    columns: list[Column] = []
    for m, name in names.items():
        old, new = F.when(known, F.col(f"old_{m}")), F.when(known, F.col(f"current_{m}"))
        columns += [
            F.round(old, 3).alias(f"{name}_per_day_previous"),
            F.round(new, 3).alias(f"{name}_per_day_current"),
            pct_change(new, old).alias(f"{name}_yoy_pct"),
        ]
    return facts.withColumn("gtfs_supply_yoy_computable", F.coalesce(complete, F.lit(False))).select(
        "operator_id", "component_feed_count", "comparable_component_feed_count",
        "gtfs_supply_yoy_computable",
        F.when(known, F.col("_old_min")).alias("previous_effective_date_min"),
        F.when(known, F.col("_old_max")).alias("previous_effective_date_max"),
        F.when(known, F.col("_now_min")).alias("current_effective_date_min"),
        F.when(known, F.col("_now_max")).alias("current_effective_date_max"),
        *columns,
        F.when(known, "measured_all_component_feeds")
        .otherwise("not_confirmed_in_downloaded_distinct_history").alias("comparison_status"),
    )
