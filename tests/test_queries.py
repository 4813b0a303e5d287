"""The registered queries as a whole, and the plans of the large ones."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from check import TABLES, rows_of
from taktline.checks import load

SF_DIR = "/root/testdata/sf0.001"
QUICK = ("trip_km", "exception_overlay", "version_classify", "table_digest", "links_operator_rollup", "anchor_select")


def test_every_sql_belongs_to_a_query():
    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries) and len(queries) > 100
    assert set(load().QUERIES) == set(load().ORACLES)


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="given tables are not here")
@pytest.mark.parametrize("name", QUICK if not os.environ.get("ALL_QUERIES") else sorted(entry.oracle_sql()))
def test_query_against_sql(spark, name):
    duck = duckdb.connect()
    for table in TABLES:
        duck.sql(f"CREATE VIEW {table} AS SELECT * FROM '{SF_DIR}/{table}.parquet'")
    assert rows_of(entry.queries()[name](spark, SF_DIR).toPandas()) == rows_of(duck.sql(entry.oracle_sql()[name]).df())


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="given tables are not here")
@pytest.mark.parametrize("name", ("trip_km", "join_trips_routes", "version_classify", "operator_history", "schedule_window"))
def test_plans_have_no_cross_join_and_no_python(spark, name):
    plan = entry.queries()[name](spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert "ArrowEvalPython" not in plan and "BatchEvalPython" not in plan


def test_intermediate_tables_need_a_shared_folder_on_a_cluster(spark):
    from taktline.workspace import shared_dir

    class Context:
        master = "yarn"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()
        conf = type("C", (), {"get": staticmethod(lambda key, default: default)})

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_dir(Session())
