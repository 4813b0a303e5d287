"""Operator statistics: field mapping, companies, completeness.

Raw records carry the header in file order and the row as a map, because the
columns differ from file to file: path, source_file, source_row, columns
ARRAY<STRING>, row MAP<STRING, STRING>. A record with a NULL row only says that
the file exists. ``path`` tells files with one member name apart; records of a
single file may leave it out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from taktline.constants import FIELD_TERMS, VEHICLE_COUNT_EXCLUDED_MARKS
from taktline.functions import (
    classify_dataset, has_value, infer_year, links_operator_id, normalize_name, strip,
)

COUNTED = ("passenger_count", "vehicle_count", "revenue", "driver_count")
GRAIN_NOTE = "Source records retained row by row; repeated operator/year/permit rows are not dropped."


def _contains_any(column: Column, terms: tuple[str, ...]) -> Column:
    hit = column.contains(terms[0])
    for term in terms[1:]:
        hit = hit | column.contains(term)
    return hit


def _matcher(field: str, terms: tuple[str, ...]):
    def matches(column: Column) -> Column:
        hit = _contains_any(column, terms)
        if field == "vehicle_count":
            hit = hit & ~_contains_any(column, VEHICLE_COUNT_EXCLUDED_MARKS)
        return hit

    return matches


def map_fields(columns: Column) -> dict[str, Column]:
    """Logical field -> matching header columns, in header order."""
    return {f: F.filter(columns, _matcher(f, terms)) for f, terms in FIELD_TERMS.items()}


def _cell(row: Column, name: Column) -> Column:
    return F.coalesce(F.when(name.isNotNull(), row[name]), F.lit(""))


def pick_column(columns: Column) -> dict[str, Column]:
    """Column that holds each identifying value; address before prefecture."""
    fields = map_fields(columns)
    first = {f: F.get(fields[f], F.lit(0)) for f in fields}
    return {
        "operator_name": first["operator_name"],
        "operator_number": first["operator_number"],
        "year": first["year"],
        "permit_type": first["permit_type"],
        "prefecture_address": F.coalesce(first["address"], first["prefecture"]),
    }


def multi_value_cell(columns: Column, row: Column) -> Column:
    """Cells of all mapped columns joined by ``|``."""
    return F.array_join(F.transform(columns, lambda c: F.coalesce(row[c], F.lit(""))), "|")


def _with_path(records: DataFrame) -> DataFrame:
    return records if "path" in records.columns else records.withColumn("path", F.lit(""))


def links_rows(records: DataFrame) -> DataFrame:
    """One row per source row; nothing is merged or dropped."""
    records = _with_path(records)
    columns, row = F.col("columns"), F.col("row")
    fields, picked = map_fields(columns), pick_column(columns)
    cells = {name: _cell(row, column) for name, column in picked.items()}
    cells["year"] = infer_year(cells["year"])
    base = records.where("row IS NOT NULL").select(
        "path", "source_file", "source_row",
        classify_dataset(F.col("source_file")).alias("dataset"),
        *[c.alias(name) for name, c in cells.items()],
        *[multi_value_cell(fields[f], row).alias(f) for f in COUNTED],
        F.exists(fields["driver_count"], lambda c: has_value(row[c])).alias("driver_valued"),
    )
    return base.withColumn(
        "links_operator_id",
        links_operator_id(F.col("operator_name"), F.col("operator_number"), F.col("prefecture_address")),
    )


def row_normalization(records: DataFrame) -> DataFrame:
    """Name keys next to the untouched source columns.

    Source columns stay in a map under ``field_<name>``: their set differs from
    file to file.
    """
    name_column = pick_column(F.col("columns"))["operator_name"]
    raw = _cell(F.col("row"), name_column)
    return records.where("row IS NOT NULL").select(
        *[c for c in ("path",) if c in records.columns], "source_file", "source_row",
        F.coalesce(name_column, F.lit("")).alias("links_name_column"),
        raw.alias("links_name_raw"), normalize_name(raw).alias("links_name_key"),
        prefixed_passthrough(F.col("row")).alias("fields"),
    )


def normalized_operators(operators: DataFrame) -> DataFrame:
    """Operators with the keys their names are compared by."""
    return operators.withColumns({
        "agency_name_key": normalize_name(F.col("agency_name")),
        "publisher_name_key": normalize_name(F.col("publisher_names")),
    })


def prefixed_passthrough(row: Column) -> Column:
    return F.transform_keys(row, lambda k, _: F.concat(F.lit("field_"), k))


def links_operator_rollup(rows: DataFrame) -> DataFrame:
    """Companies: first spelling, years, datasets, evidence flags.

    Years are four digits of 1900-2099 and there are four datasets, so both
    sets are small whatever the number of rows.
    """
    order = F.struct("path", "source_file", "source_row")
    return rows.where("links_operator_id IS NOT NULL").groupBy("links_operator_id").agg(
        F.min_by(F.struct("operator_name", "operator_number", "prefecture_address"), order).alias("_f"),
        F.min(order).alias("_o"),
        F.array_join(F.array_sort(F.collect_set(F.nullif("year", F.lit("")))), "|").alias("years"),
        F.array_join(F.array_sort(F.collect_set("dataset")), "|").alias("datasets"),
        F.count("*").alias("source_rows"),
        F.bool_or("driver_valued").alias("has_driver_count"),
        F.bool_or(F.col("dataset") == "transport_performance").alias("has_transport_performance"),
        F.bool_or(F.col("dataset") == "business_overview").alias("has_business_overview"),
    ).select("links_operator_id", "_f.*", "years", "datasets", "source_rows", "has_driver_count",
             "has_transport_performance", "has_business_overview",
             F.col("_o.path").alias("first_path"), F.col("_o.source_file").alias("first_file"),
             F.col("_o.source_row").alias("first_row"))


def field_completeness(records: DataFrame) -> DataFrame:
    """Per file, year and field: rows and companies with a value.

    The rows are read once. They are counted per company and set of fields with
    a value before these are expanded, so that a very large file is not counted
    by one task; what is left per file are its years and fields.
    """
    records = _with_path(records).where("path IS NOT NULL AND source_file IS NOT NULL")
    file = ["path", "source_file"]
    columns, row = F.col("columns"), F.col("row")
    fields, picked = map_fields(columns), pick_column(columns)
    name = _cell(row, picked["operator_name"])
    oid = links_operator_id(
        name, _cell(row, picked["operator_number"]), _cell(row, picked["prefecture_address"])
    )
    typed = records.select(
        *file, classify_dataset(F.col("source_file")).alias("dataset"), "columns", "row",
        infer_year(_cell(row, picked["year"])).alias("year"),
        F.filter(
            F.array(*[
                F.when(F.exists(c, lambda n: has_value(row[n])), F.lit(f)) for f, c in fields.items()
            ]),
            lambda f: f.isNotNull(),
        ).alias("valued"),
        F.when(has_value(name), oid).alias("oid"),
    )
    group = [*file, "dataset", "year"]
    # The field '' stands for the row itself.
    counted = (
        typed.groupBy(*group, "columns", "oid", "valued").agg(F.count("row").alias("n"))
        .select(*group, "columns", "oid", "n", F.explode_outer(F.array_union(F.array(F.lit("")), "valued")).alias("field"))
        .groupBy(*group, "field", "oid").agg(F.sum("n").alias("n"), F.max("columns").alias("columns"))
        .groupBy(*group, "field").agg(F.sum("n").alias("n"), F.count("oid").alias("ids"), F.max("columns").alias("columns"))
    )
    totals = counted.groupBy(*group).agg(
        F.max(F.when(F.col("field") == "", F.col("n"))).alias("rows_total"), F.max("columns").alias("_columns"),
        F.map_from_entries(F.collect_list(F.struct("field", F.struct("n", "ids")))).alias("_counts"),
    )
    # A file with any year is reported by year, and its rows without one are
    # left out; a file without years is reported as a whole.
    whole = Window.partitionBy(*file)
    header = map_fields(F.col("_columns"))
    grid = totals.withColumns({"_last_year": F.max("year").over(whole), "_columns": F.max("_columns").over(whole)}).where(
        (F.col("year") != "") | (F.col("_last_year") == "")
    ).select(
        *group, "rows_total", "_counts",
        F.explode(F.create_map(*[x for f, c in header.items() for x in (F.lit(f), F.array_join(c, "|"))])).alias("field", "columns"),
    )
    found = F.col("_counts")[F.col("field")]
    return grid.select(
        "path", "dataset", "source_file", "year", "field", "columns", "rows_total",
        F.coalesce(found["n"], F.lit(0)).alias("rows_nonblank"),
        F.coalesce(found["ids"], F.lit(0)).alias("unique_operator_ids_nonblank"),
        F.when(F.col("columns") != "", "measured_from_csv").otherwise("column_not_present").alias("status"),
        F.lit(GRAIN_NOTE).alias("grain_note"),
    )


def _valued(c: str, blank_rule: str) -> Column:
    if blank_rule == "strict":
        return F.exists(F.split(F.col(c), "\\|"), has_value)
    if blank_rule == "separators":
        return F.btrim(F.coalesce(c, F.lit("")), F.lit("| ")) != ""
    raise ValueError(f"unknown blank rule: {blank_rule}")


def transport_complete(rows: DataFrame, blank_rule: str = "strict") -> DataFrame:
    """Per company, year and permit: both datasets present, one complete row.

    All values have to be in the same source row. ``blank_rule="separators"``
    takes every mark but ``|`` and blanks for a value, also ``-``.
    """
    p, v, r, d = (_valued(c, blank_rule) for c in COUNTED)
    transport = F.col("dataset") == "transport_performance"
    return rows.where("links_operator_id IS NOT NULL AND year <> ''").groupBy(
        "links_operator_id", "year", strip(F.col("permit_type")).alias("permit_type")
    ).agg(
        F.bool_or(transport).alias("in_transport"),
        F.bool_or(F.col("dataset") == "business_overview").alias("in_overview"),
        F.bool_or(transport & p & v & r).alias("transport_complete"),
        F.bool_or(transport & p & v & r & d).alias("driver_complete"),
    )


def common_year_permit(per_permit: DataFrame) -> DataFrame:
    """Newest (year, permit) of a company that both datasets have."""
    return per_permit.where("in_transport AND in_overview").groupBy("links_operator_id").agg(
        F.max(F.struct("year", "permit_type", "transport_complete", "driver_complete")).alias("_c")
    ).select(
        "links_operator_id", F.col("_c.year").alias("common_links_year"),
        F.col("_c.permit_type").alias("common_permit_type"),
        "_c.transport_complete", "_c.driver_complete",
    )
