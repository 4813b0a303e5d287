"""Completeness of statistics: rows read once, and the work per row dealt over all cores."""

from pyspark.sql import functions as F

from taktline.checks.links_views import LinksViews
from taktline.operators import links

SCHEMA = "path string, source_file string, source_row long, columns array<string>, row map<string,string>"
HEAD = ["事業者名", "対象年度", "運転者数"]


def _records(spark):
    rows = [("a", "yusoujisseki_1.csv", i, HEAD, {"事業者名": f"バス{i % 3}", "対象年度": "2021年度" if i % 5 else "", "運転者数": "-" if i % 2 else "5"}) for i in range(40)]
    rows += [("b", "other.csv", i, HEAD[:1], {"事業者名": "" if i else "バス"}) for i in range(4)]
    rows += [("c", "empty.csv", 0, HEAD[:2], None), ("d", "none.csv", 0, None, None), (None, "lost.csv", 1, HEAD, {"事業者名": "x"}), ("e", None, 1, HEAD, {"事業者名": "x"})]
    rows += [("a", "yusoujisseki_1.csv", 41, [*HEAD, "車両数"], {"事業者名": "バス1", "対象年度": "2021", "車両数": "3"})]
    return spark.createDataFrame(rows, SCHEMA)


def test_counts_of_files_years_and_fields(spark):
    got = {(r.path, r.year, r.field): r for r in links.field_completeness(_records(spark)).collect()}
    assert {p for p, _, _ in got} == {"a", "b", "c", "d"}  # a file without a path or a name is none
    assert {y for p, y, _ in got if p == "a"} == {"2021"} and {y for p, y, _ in got if p != "a"} == {""}
    name, drivers, vehicles = (got["a", "2021", f] for f in ("operator_name", "driver_count", "vehicle_count"))
    assert (name.rows_total, name.rows_nonblank, name.unique_operator_ids_nonblank) == (33, 33, 3)
    assert (drivers.rows_total, drivers.rows_nonblank, drivers.unique_operator_ids_nonblank) == (33, 16, 3)
    assert (vehicles.rows_nonblank, vehicles.columns, vehicles.status) == (1, "車両数", "measured_from_csv")
    assert (got["b", "", "operator_name"].rows_total, got["b", "", "operator_name"].rows_nonblank) == (4, 1)
    assert (got["b", "", "driver_count"].columns, got["b", "", "driver_count"].status) == ("", "column_not_present")
    assert (got["c", "", "year"].rows_total, got["c", "", "year"].columns) == (0, "対象年度")
    assert (got["d", "", "year"].rows_total, got["d", "", "year"].columns, got["d", "", "year"].status) == (0, None, "column_not_present")


def test_rows_are_read_once(spark, tmp_path):
    _records(spark).write.parquet(f"{tmp_path}/records")
    plan = links.field_completeness(spark.read.parquet(f"{tmp_path}/records"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1


def _customers(spark, tmp_path):
    spark.range(500).select(
        F.col("id").alias("c_custkey"), F.concat(F.lit("c"), "id").alias("c_name"), (F.col("id") % 5).cast("int").alias("c_nationkey"),
        (F.col("id") - 9.0).alias("c_acctbal"), F.lit("BUS").alias("c_mktsegment"),
    ).coalesce(1).write.parquet(f"{tmp_path}/customer.parquet")
    return LinksViews(spark, str(tmp_path))


def test_no_filter_goes_back_to_the_one_task_of_a_small_table(spark, tmp_path):
    assert len(_customers(spark, tmp_path).records.inputFiles()) > 1


def test_rows_of_statistics_are_made_once(spark, tmp_path):
    views = _customers(spark, tmp_path)
    assert not any("customer" in f for f in views.links_rows.inputFiles())
    assert views.links_rows.count() == 500
