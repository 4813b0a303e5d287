"""How many operators survive each stage, by region, indicator and gap."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from taktline.constants import (
    LINKS_UNAVAILABLE, PREFECTURE_UNKNOWN_BUCKET, PREFECTURES, VERDICT_MIN_OPERATORS,
)
from taktline.functions import name_signals, safe_rate


def _null(kind: str) -> Column:
    return F.lit(None).cast(kind)


def operator_flags(
    operators: DataFrame, matched: DataFrame, common: DataFrame, history: DataFrame
) -> DataFrame:
    """Per operator: company, newest common year and the stage conditions."""
    no = F.lit(False)
    matches = matched.select("operator_id", "match_class", "links_operator_id", "links_operator_name")
    h = history.select("operator_id", "years_2plus_all_feeds", "years_3plus_all_feeds")
    return operators.join(matches, "operator_id", "left").join(common, "links_operator_id", "left").join(
        h, "operator_id", "left"
    ).withColumns({
        "matched": F.col("links_operator_id").isNotNull(),
        "transport_complete": F.coalesce("transport_complete", no),
        "overview_present": F.col("common_links_year").isNotNull(),
        "driver_complete": F.coalesce("driver_complete", no),
        "history_2plus": F.coalesce("years_2plus_all_feeds", no),
        "history_3plus": F.coalesce("years_3plus_all_feeds", no),
    })


def stage_conditions() -> list[Column]:
    """Conditions of stages 2 to 7; each contains the one before it."""
    t = F.col("transport_complete")
    to = t & F.col("overview_present")
    tod = to & F.col("driver_complete")
    return [F.col("matched"), t, to, tod, tod & F.col("history_2plus"), tod & F.col("history_3plus")]


def full() -> Column:
    return stage_conditions()[-1]


def operator_detail(flags: DataFrame, available: bool = True, metrics: tuple[str, ...] = ()) -> DataFrame:
    """Operators with match, completeness and history; unknown stays unknown.

    ``metrics``: more columns of the operators to carry along.
    """
    def known(name: str, kind: str = "boolean") -> Column:
        return F.col(name) if available else _null(kind)

    return flags.select(
        "operator_id", "agency_name", "prefectures",
        F.coalesce("match_class", F.lit("E" if available else "not_evaluable")).alias("match_class"),
        "links_operator_id", "links_operator_name",
        known("common_links_year", "string").alias("common_links_year"),
        known("common_permit_type", "string").alias("common_permit_type"),
        known("transport_complete").alias("transport_performance_complete"),
        known("overview_present").alias("business_overview_present"),
        known("driver_complete").alias("driver_count_complete"),
        F.col("years_2plus_all_feeds").alias("gtfs_2plus_year_history"),
        F.col("years_3plus_all_feeds").alias("gtfs_3plus_year_history"),
        F.lit("" if available else "LINKS source unavailable; match and LINKS field status unknown").alias("drop_reason"),
        *[m for m in metrics if m not in ("operator_id", "agency_name", "prefectures")],
    )


# Stage names and their status when measured.
STAGES = [
    ("Funnel 1 GTFS bus operator entities", "measured"),
    ("Funnel 2 LINKS matched A/B/C", "measured"),
    ("Funnel 3 transport passenger+vehicle+revenue", "measured_conservative_same_year"),
    ("Funnel 4 plus business overview", "measured_conservative_same_year"),
    ("Funnel 5 plus driver count", "measured_conservative_same_year"),
    ("Funnel 6 plus 2+ year GTFS history", "measured_all_component_feeds"),
    ("Funnel 7 plus 3+ year GTFS history", "measured_all_component_feeds"),
]


def funnel(flags: DataFrame, available: bool = True) -> DataFrame:
    """Seven cumulative stages out of one pass."""
    counts = flags.agg(
        F.count("*").alias("c0"),
        *[F.count_if(c).alias(f"c{i}") for i, c in enumerate(stage_conditions(), 1)],
    )
    rows = []
    for i, (stage, status) in enumerate(STAGES):
        known = available or i == 0
        rows.append(
            F.struct(
                F.lit(stage).alias("stage"),
                (F.col(f"c{i}") if known else _null("bigint")).alias("operator_count"),
                F.lit(status if known else LINKS_UNAVAILABLE).alias("status"),
            )
        )
    return counts.select(F.inline(F.array(*rows)))


def prefecture_summary(flags: DataFrame, available: bool = True) -> DataFrame:
    """All 47 prefectures and one bucket for the rest, also those without operators.

    An operator counts once in each prefecture it serves, and nowhere without any.
    """
    listed = F.array(*[F.lit(p) for p in PREFECTURES])
    buckets = F.array_distinct(
        F.transform(
            F.filter(F.split("prefectures", "\\|"), lambda p: p != ""),
            lambda p: F.when(F.array_contains(listed, p), p).otherwise(F.lit(PREFECTURE_UNKNOWN_BUCKET)),
        )
    )
    counted = flags.select(F.explode(buckets).alias("prefecture"), F.col("matched").alias("m"), full().alias("f"))
    # One zero row per prefecture joins the counts, so that none is missing.
    every = flags.sparkSession.range(1).select(
        F.explode(F.array(*[F.lit(p) for p in [*PREFECTURES, PREFECTURE_UNKNOWN_BUCKET]])).alias("prefecture"),
        _null("boolean").alias("m"), _null("boolean").alias("f"),
    )
    sums = counted.unionByName(every).groupBy("prefecture").agg(
        F.count("m").alias("n"), F.count_if("m").alias("matched"), F.count_if("f").alias("complete")
    )
    rate = F.coalesce(safe_rate(F.col("complete"), F.col("n")), F.lit(0.0))
    return sums.select(
        "prefecture", F.col("n").alias("gtfs_bus_operator_entities"),
        (F.col("matched") if available else _null("bigint")).alias("links_matched_A_B_C"),
        (F.col("complete") if available else _null("bigint")).alias("full_complete"),
        (rate if available else _null("double")).alias("coverage_rate"),
        F.lit("measured" if available else LINKS_UNAVAILABLE).alias("links_status"),
    )


def region_detail(
    flags: DataFrame, registry: DataFrame, prefecture: str = "愛媛県", code: int = 38, available: bool = True,
    metrics: tuple[str, ...] = (),
) -> DataFrame:
    """Operators of one prefecture, or one row that says none was found."""
    detail = operator_detail(flags, available, metrics).where(F.col("prefectures").contains(prefecture)).withColumn(
        "name_check", name_signals(F.col("agency_name"))["iyo_rail_check"]
    )
    # One row with the number of catalogue rows and of operators found.
    tagged = detail.select(F.lit("o").alias("k")).unionByName(
        registry.where(F.col("feed_pref_id") == code).select(F.lit("r").alias("k"))
    )
    nothing = tagged.agg(
        F.count_if(F.col("k") == "o").alias("_found"),
        F.count_if(F.col("k") == "r").alias("registry_feed_rows"),
    ).where("_found = 0").select(
        F.lit(prefecture).alias("prefectures"), F.lit("not_evaluable").alias("match_class"),
        F.lit("not_found_in_official_registry_or_selected_agency_txt").alias("gtfs_status"), "registry_feed_rows",
    )
    return detail.unionByName(nothing, allowMissingColumns=True)


# Code, name, data the indicator needs, rule of its count.
INDICATORS = [
    ("A", "GTFS service quantity / vehicle count", "weekday GTFS trip-hours/day proxy + LINKS vehicle metric", "year"),
    ("B", "GTFS service quantity / driver count", "weekday GTFS trip-hours/day proxy + LINKS driver count", "driver"),
    ("C", "passengers / drivers", "LINKS passenger_count + driver_count, same operator/year", "driver"),
    ("D", "revenue / drivers", "LINKS revenue + driver_count, same operator/year", "driver"),
    ("E", "revenue / GTFS supply", "LINKS revenue + dated GTFS trip-hours/day proxy", "year"),
    ("F", "passengers / GTFS supply", "LINKS passenger_count + dated GTFS trip-hours/day proxy", "year"),
    ("G", "GTFS supply year-over-year", "distinct timetable generations with dated history and version metrics", "supply"),
    ("H", "driver count year-over-year", "LINKS driver count for two comparable years", "none"),
    ("I", "passenger count year-over-year", "LINKS passenger count for two comparable years", "none"),
    ("J", "revenue year-over-year", "LINKS revenue for two comparable years", "none"),
]


# What the count of an indicator does not say.
LIMITATIONS = {
    "supply_without_links": "Computed only from dated distinct GTFS schedule generations; no LINKS values are implied.",
    "supply": "Measured from distinct dated timetables in all component feeds; LINKs is not required for this GTFS-only change.",
    "no_history": "GTFS history metrics have not been generated.",
    "no_links": "0 confirmed computable from retrieved bytes; the true availability in the inaccessible LINKS CSV remains unknown.",
    "rows": "Computed count is a conservative row-availability count, not a claim that the ratio is comparable across permit classes.",
}


def indicator_feasibility(
    flags: DataFrame, supply: DataFrame | None, available: bool = True
) -> DataFrame:
    """For ten indicators: operators that have the data, a status, and what the count does not say."""
    year = F.col("transport_complete") & F.col("overview_present")
    driver = F.col("transport_complete") & F.col("driver_complete")
    tagged = flags.select(year.alias("year"), driver.alias("driver"), F.lit(False).alias("supply"))
    if supply is not None:
        tagged = tagged.unionByName(
            supply.select(
                F.lit(False).alias("year"), F.lit(False).alias("driver"),
                F.col("gtfs_supply_yoy_computable").alias("supply"),
            )
        )
    counts = tagged.agg(*[F.count_if(c).alias(c) for c in ("year", "driver", "supply")])
    rows = []
    for code, name, needs, rule in INDICATORS:
        if rule == "supply":
            count = F.col("supply") if supply is not None else _null("bigint")
            status = F.when(F.col("supply") > 0, "partially_possible_GTFS_only").otherwise(
                "not_confirmed_in_downloaded_GTFS_history"
            ) if supply is not None else F.lit("not_evaluable_GTFS_history_not_run")
            category = F.when(F.col("supply") > 0, "一部可能（GTFS時刻表だけで供給量前年比を確認）").otherwise(
                "今回の取得履歴では未確認"
            ) if supply is not None else F.lit("未評価")
            population = "measured_from_GTFS_history" if supply is not None else (
                "measured_from_source_rows"
            )
            limit = "no_history" if supply is None else "supply" if available else "supply_without_links"
        elif not available:
            count = _null("bigint")
            status = F.lit("not_computable_from_acquired_data_LINKS_source_unavailable")
            category = F.lit("不可能（今回取得データだけでは計算不可）")
            population, limit = "unknown_LINKS_source_unavailable", "no_links"
        else:
            count = _null("bigint") if rule == "none" else F.col(rule)
            some = F.coalesce(count > 0, F.lit(False))
            status = F.when(
                some, "partially_possible; exact numerator/denominator matching must be checked"
            ).otherwise("not_computable_from_measured_rows")
            category = F.when(some, "一部可能").otherwise("不可能（今回実査した行では計算不可）")
            population, limit = "measured_from_source_rows", "rows"
        rows.append(
            F.struct(
                F.lit(code).alias("indicator"), F.lit(name).alias("name"), status.alias("feasibility"),
                category.alias("requested_category"), count.alias("operators_with_required_data"),
                F.lit(population).alias("true_population_count_status"), F.lit(needs).alias("required_data"),
                F.lit(LIMITATIONS[limit]).alias("limitations"),
            )
        )
    return counts.select(F.inline(F.array(*rows)))


# -- gaps and grains ----------------------------------------------------------


def _one_row(measures: list[tuple[DataFrame, dict[str, Column]]]) -> DataFrame:
    """Aggregates of several tables in one row of type MAP<STRING, BIGINT>.

    Each table becomes a handful of (name, value) rows before they meet.
    """
    long = []
    for df, columns in measures:
        one = df.agg(*[c.cast("bigint").alias(n) for n, c in columns.items()])
        pairs = F.array(*[F.struct(F.lit(n).alias("name"), F.col(n).alias("value")) for n in columns])
        long.append(one.select(F.inline(pairs)))
    return reduce(DataFrame.unionByName, long).agg(
        F.map_from_entries(F.collect_list(F.struct("name", "value"))).alias("m")
    )


def audit_counts(
    registry: DataFrame, selection: DataFrame, feed_metrics: DataFrame, agency_metrics: DataFrame,
    operators: DataFrame, history: DataFrame,
) -> DataFrame:
    """All counts the gap and grain tables are made of."""
    status = F.col("status")
    signals = name_signals(F.col("agency_name"))
    several = F.col("feed_count") > 1
    return _one_row([
        (registry, {"registry": F.count("*")}),
        (selection, {
            "selected": F.count_if(status == "selected"),
            "discontinued": F.count_if(status.startswith("excluded_discontinued")),
            "no_archive": F.count_if(status == "no_downloaded_archive_valid_on_anchor"),
        }),
        (feed_metrics, {
            "bus_feeds": F.count_if(status == "bus_feed_analyzed"),
            "no_bus_feeds": F.count_if(status == "no_bus_route_type"),
            "multi_agency_feeds": F.count_if(F.col("bus_agency_count") > 1),
        }),
        (agency_metrics.groupBy("organization_id", "feed_id").agg(F.count("*").alias("n")),
         {"agency_rows": F.coalesce(F.sum("n"), F.lit(0)), "named_feeds": F.count("*")}),
        (operators.groupBy("agency_name").agg(
            F.count("*").alias("n"), F.count_if(~F.col("schedule_status_all_dated")).alias("undated"),
            F.count_if(several).alias("several"), F.max("feed_count").alias("most")),
         {"entities": F.coalesce(F.sum("n"), F.lit(0)), "names": F.count("*"),
          "undated": F.coalesce(F.sum("undated"), F.lit(0)),
          "multi_feed": F.coalesce(F.sum("several"), F.lit(0)), "max_feeds": F.coalesce(F.max("most"), F.lit(0)),
          "municipal": F.coalesce(F.sum(F.when(signals["municipal_suffix"], F.col("n"))), F.lit(0)),
          "council": F.coalesce(F.sum(F.when(signals["council_name"], F.col("n"))), F.lit(0))}),
        (history, {"history_2": F.count_if("years_2plus_all_feeds"), "history_3": F.count_if("years_3plus_all_feeds")}),
    ])


# Gap, count, denominator, unit, status.
GAPS = [
    ("gtfs_registry_records", "registry", "registry", "official feed-pair record", "measured"),
    ("gtfs_archive_valid_on_anchor", "selected", "registry", "feed archive", "measured_from_zip_feed_info"),
    ("gtfs_marked_discontinued_excluded", "discontinued", "registry", "feed-pair record", "measured_from_registry"),
    ("gtfs_no_downloaded_archive_valid_on_anchor", "no_archive", "registry", "feed-pair record", "measured_from_zip_feed_info"),
    ("gtfs_selected_feed_with_bus_route_type", "bus_feeds", "selected", "feed archive", "measured_from_routes.txt"),
    ("gtfs_named_bus_agency_feed_pairs", "named_feeds", "bus_feeds", "feed archive with agency_name", "measured_from_agency_txt"),
    ("gtfs_selected_feed_without_bus_route_type", "no_bus_feeds", "selected", "feed archive", "measured_from_routes.txt"),
    ("gtfs_feeds_with_multiple_bus_agency_rows", "multi_agency_feeds", "bus_feeds", "feed archive", "measured_from_agency_txt_and_routes_txt"),
    ("gtfs_bus_agency_entities_without_LINKS_comparison", "entities", "entities", "agency-derived entity", LINKS_UNAVAILABLE),
    ("links_dataset_rows_or_operator_count", None, None, "LINKS source rows/operators", "unknown_HTTP_403"),
    ("links_driver_count_completeness", None, None, "LINKS bus operator/year", "unknown_SOURCE_NOT_RETRIEVED"),
    ("gtfs_entities_without_dated_schedule_metrics", "undated", "entities", "agency-derived entity", "measured"),
    ("gtfs_agency_name_municipal_suffix_signal", "municipal", "entities", "agency-derived entity", "measured_string_signal_not_classification"),
    ("gtfs_agency_name_council_signal", "council", "entities", "agency-derived entity", "measured_string_signal_not_classification"),
    ("gtfs_entities_with_multiple_feeds", "multi_feed", "entities", "agency-derived entity", "measured"),
    ("gtfs_history_2plus_years_all_component_feeds", "history_2", "entities", "agency-derived entity", "measured_after_history_run"),
    ("gtfs_history_3plus_years_all_component_feeds", "history_3", "entities", "agency-derived entity", "measured_after_history_run"),
]

# Grain, count, unit.
GRAINS = [
    ("registry feed-pairs", "registry", "feed record"),
    ("anchor-valid ZIP feed archives", "selected", "feed archive"),
    ("selected bus agency.txt rows", "agency_rows", "agency record across feed archives"),
    ("selected bus feeds containing agency_name", "named_feeds", "feed archive"),
    ("feeds with multiple bus agency rows", "multi_agency_feeds", "feed archive"),
    ("agency-derived entities", "entities", "normalized agency/provenance entity"),
    ("distinct raw agency_name strings", "names", "display name"),
    ("entities with multiple component feeds", "multi_feed", "agency-derived entity"),
    ("municipal-suffix names", "municipal", "agency-derived entity"),
    ("council-name signal", "council", "agency-derived entity"),
    ("LINKS source grain", None, "unknown"),
]

# What a gap is and what it is not. ``{anchor}`` and ``{max_feeds}`` are filled in.
GAP_NOTES = {
    "gtfs_registry_records": "Registry rows are feed records, not operators.",
    "gtfs_archive_valid_on_anchor": "Selected archives have an internal feed_info validity window containing {anchor}.",
    "gtfs_marked_discontinued_excluded": "Discontinued on/before anchor or discontinuation date unknown.",
    "gtfs_no_downloaded_archive_valid_on_anchor": "See anchor_feed_selection.csv for each feed's metadata and validity.",
    "gtfs_selected_feed_with_bus_route_type": "A feed can contain multiple agency rows; this is not a bus-operator count.",
    "gtfs_named_bus_agency_feed_pairs": "One agency/feed pair may yield multiple agency rows.",
    "gtfs_selected_feed_without_bus_route_type": "No route with route_type 3, 11, or 700-799.",
    "gtfs_feeds_with_multiple_bus_agency_rows": "Multiple distinct agency rows in one feed are preserved, not collapsed.",
    "gtfs_bus_agency_entities_without_LINKS_comparison": "0 confirmed matches; true match count unknown, not Match E.",
    "links_dataset_rows_or_operator_count": "Unknown, not zero; public CKAN API and resource URL returned HTTP 403.",
    "links_driver_count_completeness": "The 2025 CSV column, year, nonblank count, and grain were not inspectable.",
    "gtfs_entities_without_dated_schedule_metrics": "Missing/incomplete calendar validity yields blank metrics, not zero.",
    "gtfs_agency_name_municipal_suffix_signal": "agency_name ends in 市/区/町/村; this is not proof of legal operator identity.",
    "gtfs_agency_name_council_signal": "agency_name contains 協議会; actual operating company remains unverified.",
    "gtfs_entities_with_multiple_feeds": "Maximum component feeds per entity={max_feeds}; feed rows are preserved; agency totals are raw feed sums.",
    "gtfs_history_2plus_years_all_component_feeds": "GTFS-only history; does not imply LINKS or driver completeness.",
    "gtfs_history_3plus_years_all_component_feeds": "GTFS-only history; does not imply LINKS or driver completeness.",
}
# What is counted at a grain.
GRAIN_NOTES = {
    "registry feed-pairs": "Official API rows; not operator count.",
    "anchor-valid ZIP feed archives": "Current public ZIP with internal feed_info validity at anchor.",
    "selected bus agency.txt rows": "Preserved at feed/agency grain.",
    "selected bus feeds containing agency_name": "Distinct organization_id/feed_id pairs represented in agency-level output.",
    "feeds with multiple bus agency rows": "These feeds contribute more than one agency row; examples remain in gtfs_agency_metrics.csv.",
    "agency-derived entities": "Not legal-operator verified.",
    "distinct raw agency_name strings": "A name may appear in multiple publisher-qualified entities.",
    "entities with multiple component feeds": "Maximum feed count={max_feeds}; component feed IDs and per-feed rows remain in metrics.",
    "municipal-suffix names": "Name signal only; not an entity type determination.",
    "council-name signal": "Name signal only; actual operating company unresolved.",
    "LINKS source grain": "Cannot distinguish operator/region/branch/permit repetition without CSV and specification.",
}


def _note(text: str, anchor: object = "") -> Column:
    most = F.coalesce(F.col("m")["max_feeds"], F.lit(0)).cast("string")
    return F.replace(F.lit(text.replace("{anchor}", str(anchor))), F.lit("{max_feeds}"), most)


def _measure(name: str | None) -> Column:
    return _null("bigint") if name is None else F.col("m")[name]


def data_gap_summary(counts: DataFrame, anchor: object) -> DataFrame:
    """Seventeen gaps with count, denominator, rate and a note; ``anchor`` is the date the archives were selected for."""
    rows = [
        F.struct(
            F.lit(gap).alias("gap_or_grain"), _measure(n).alias("count"), _measure(d).alias("denominator"),
            safe_rate(_measure(n), _measure(d)).alias("rate"), F.lit(unit).alias("unit"), F.lit(status).alias("status"),
            _note(GAP_NOTES[gap], anchor).alias("note"),
        )
        for gap, n, d, unit, status in GAPS
    ]
    return counts.select(F.inline(F.array(*rows)))


def grain_summary(counts: DataFrame) -> DataFrame:
    """Eleven grains that must never be mixed, with their counts."""
    rows = [
        F.struct(
            F.lit(grain).alias("grain"), _measure(n).alias("count"), F.lit(unit).alias("unit"),
            _note(GRAIN_NOTES[grain]).alias("note"),
        )
        for grain, n, unit in GRAINS
    ]
    return counts.select(F.inline(F.array(*rows)))


def verdict(flags: DataFrame, available: bool = True, needed: int = VERDICT_MIN_OPERATORS) -> DataFrame:
    """One row: does the data carry a national result."""
    complete = F.col("full_complete")
    if not available:
        complete = _null("bigint")
    return flags.agg(F.count_if(full()).alias("full_complete")).select(
        complete.alias("full_complete"),
        F.when(F.coalesce(complete >= needed, F.lit(False)), "CONDITIONAL PASS").otherwise("FAIL").alias("verdict"),
    )
