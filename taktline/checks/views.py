"""Timetable-shaped views that Spark derives from the given tables.

The views grow with the tables. They are built to contain the awkward cases:
repeated sequence numbers, missing times and coordinates, blank agency ids,
unknown services, repeated exceptions, ambiguous names.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from taktline.operators.service import ServiceModel
from taktline.workspace import Workspace


_SCHEMAS: dict[str, StructType] = {}


def day0() -> Column:
    return F.lit("1998-01-01").cast("date")


def text(prefix: str, number: Column | str) -> Column:
    number = F.col(number) if isinstance(number, str) else number
    return F.concat(F.lit(prefix), number.cast("string"))


class Views:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir
        self._spread: dict[tuple[str, str], DataFrame] = {}

    @cached_property
    def workspace(self) -> Workspace:
        return Workspace(self.spark)

    def table(self, name: str) -> DataFrame:
        """A given table; the footer is read once per folder for its schema."""
        path = f"{self.sf_dir}/{name}.parquet"
        if path not in _SCHEMAS:
            _SCHEMAS[path] = self.spark.read.parquet(path).schema
        return self.spark.read.schema(_SCHEMAS[path]).parquet(path)

    def spread(self, name: str, key: str) -> DataFrame:
        """A given table dealt over all cores, for work that takes long per row: one task reads a file of one row group.

        It is written, because filters would move in front of a shuffle, with all the work that they depend on.
        """
        if (name, key) not in self._spread:
            dealt = self.table(name).repartition(4 * self.spark.sparkContext.defaultParallelism, key)
            self._spread[name, key] = self.workspace.keep(dealt, f"{name}-spread")
        return self._spread[name, key]

    # -- archives -------------------------------------------------------------

    @cached_property
    def archives(self) -> DataFrame:
        k = F.col("n_nationkey")
        return self.table("nation").select(
            text("org", "n_regionkey").alias("organization_id"),
            text("feed", k).alias("feed_id"),
            F.lit("current").alias("version_selector"),
            F.date_add(F.lit("1997-10-01").cast("date"), k * 20).alias("anchor_date"),
            F.concat(F.lit("archives/"), text("feed", k), F.lit(".zip")).alias("source_zip"),
            F.sha2(text("feed", k), 256).alias("source_zip_sha256"),
        )

    @cached_property
    def feeds(self) -> DataFrame:
        k = F.col("n_nationkey")
        return self.table("nation").select(
            text("org", "n_regionkey").alias("organization_id"),
            text("feed", k).alias("feed_id"),
            text("Publisher ", "n_regionkey").alias("publisher_name"),
            text("Feed ", k).alias("feed_name"),
            (k + 1).alias("feed_pref_id"),
        )

    @cached_property
    def _supplier_feed(self) -> DataFrame:
        nation = self.table("nation")
        supplier = self.table("supplier")
        owned = supplier.join(nation, supplier.s_nationkey == nation.n_nationkey).select(
            "s_suppkey",
            text("org", "n_regionkey").alias("organization_id"),
            text("feed", "s_nationkey").alias("feed_id"),
            F.lit("current").alias("version_selector"),
        )
        # As a table it has a size that Spark knows; of a join it takes the product, and shuffles all stop times to meet it.
        return self.workspace.keep(owned, "supplier_feed")

    def _feed_of(self, df: DataFrame, supplier_no: Column) -> DataFrame:
        """Attach the feed that owns supplier number ``supplier_no``."""
        return df.withColumn("s_suppkey", supplier_no).join(self._supplier_feed, "s_suppkey")

    @property
    def _suppliers(self) -> Column:
        return self.table("supplier").select(F.count("*")).scalar()

    @property
    def _parts(self) -> Column:
        return self.table("part").select(F.count("*")).scalar()

    # -- timetable ------------------------------------------------------------

    @cached_property
    def agency(self) -> DataFrame:
        s = F.col("s_suppkey")
        k = s % 40
        name = (
            F.when(k == 38, "QWERTYUIOP")
            .when(s % 4 == 0, text("株式会社バス", k))
            .when(s % 4 == 1, F.concat(text("バス", k), F.lit("(株)")))
            .when(s % 4 == 2, F.concat(text("バス ", k), F.lit(" ")))
            .otherwise(text("バス", k))
        )
        url = F.when(s % 5 == 0, "").otherwise(
            F.concat(text("https://www.op", s % 20), F.lit(".example.jp/"))
        )
        return self._supplier_feed.select(
            "organization_id", "feed_id", "version_selector",
            F.when(s % 9 == 4, "").otherwise(text("a", s)).alias("agency_id"),
            name.alias("agency_name"), url.alias("agency_url"), s.alias("row_ix"),
        )

    @cached_property
    def routes(self) -> DataFrame:
        p = F.col("p_partkey")
        owned = self._feed_of(self.table("part").withColumn("ns", self._suppliers), p % F.col("ns"))
        s, size = F.col("s_suppkey"), F.col("p_size") % 5
        return owned.select(
            "organization_id", "feed_id", "version_selector",
            text("r", p).alias("route_id"),
            F.when((p % 10 == 7) | (s % 9 == 4), "").otherwise(text("a", s)).alias("agency_id"),
            F.when(size == 0, "3").when(size == 1, "11").when(size == 2, "715").when(size == 3, "2")
            .otherwise("x").alias("route_type"),
            p.alias("row_ix"),
        )

    @cached_property
    def trips(self) -> DataFrame:
        o = F.col("o_orderkey")
        counted = self.table("orders").withColumn("np", self._parts).withColumn("ns", self._suppliers)
        owned = self._feed_of(counted, (o % F.col("np")) % F.col("ns"))
        return owned.select(
            "organization_id", "feed_id", "version_selector",
            text("t", o).alias("trip_id"),
            text("r", o % F.col("np")).alias("route_id"),
            text("s", F.col("o_custkey") % 12).alias("service_id"),
            o.alias("row_ix"),
        )

    @cached_property
    def stop_times(self) -> DataFrame:
        o, line = F.col("l_orderkey"), F.col("l_linenumber")
        counted = self.table("lineitem").withColumn("np", self._parts).withColumn("ns", self._suppliers)
        owned = self._feed_of(counted, (o % F.col("np")) % F.col("ns"))
        t = 18000 + (o * 137) % 57600 + line * 180
        return owned.select(
            "organization_id", "feed_id", "version_selector",
            text("t", o).alias("trip_id"),
            text("st", "l_partkey").alias("stop_id"),
            line.alias("stop_sequence"),
            F.when(F.col("l_returnflag") != "R", t).alias("arrival_sec"),
            F.when(~((F.col("l_returnflag") == "N") & (F.col("l_linestatus") == "F")), t + 30)
            .alias("departure_sec"),
            ((F.col("l_partkey") * 100000 + F.col("l_suppkey")) * 100
             + F.floor("l_quantity")).alias("row_ix"),
        )

    @cached_property
    def stops(self) -> DataFrame:
        n = F.substring("stop_id", 3, 18).try_cast("bigint")
        known = n % 97 != 0
        return self.stop_times.select(
            "organization_id", "feed_id", "version_selector", "stop_id"
        ).distinct().select(
            "*",
            F.when(known, F.lit(33.0) + ((n * 7919) % 10000).cast("double") / 10000).alias("stop_lat"),
            F.when(known, F.lit(132.0) + ((n * 104729) % 10000).cast("double") / 10000).alias("stop_lon"),
            n.alias("row_ix"),
        )

    @cached_property
    def calendar(self) -> DataFrame:
        k = F.col("k")
        week, end = k % 3 != 2, k % 3 != 0
        return self.table("nation").select(
            text("org", "n_regionkey").alias("organization_id"),
            text("feed", "n_nationkey").alias("feed_id"),
            F.lit("current").alias("version_selector"),
            F.explode(F.sequence(F.lit(0), F.lit(11))).alias("k"),
        ).select(
            "organization_id", "feed_id", "version_selector",
            text("s", k).alias("service_id"),
            F.date_add(day0(), k * 17).alias("start_date"),
            F.date_add(day0(), k * 27 + 200).alias("end_date"),
            F.array(*[week] * 5, *[end] * 2).alias("flags"),
            k.cast("bigint").alias("row_ix"),
        )

    @cached_property
    def calendar_dates(self) -> DataFrame:
        c = F.col("c_custkey")
        nation = self.table("nation")
        feed_no = (c % 25).cast("int")
        return self.table("customer").join(nation, feed_no == nation.n_nationkey).select(
            text("org", "n_regionkey").alias("organization_id"),
            text("feed", "n_nationkey").alias("feed_id"),
            F.lit("current").alias("version_selector"),
            text("s", c % 14).alias("service_id"),
            F.date_add(day0(), (((c * 31) % 60) * 8).cast("int")).alias("date"),
            F.when(c % 11 == 0, 3).when(c % 13 < 7, 1).otherwise(2).alias("exception_type"),
            c.alias("row_ix"),
        )

    @cached_property
    def feed_info(self) -> DataFrame:
        k = F.col("n_nationkey")
        return self.table("nation").select(
            text("org", "n_regionkey").alias("organization_id"),
            text("feed", k).alias("feed_id"),
            F.lit("current").alias("version_selector"),
            F.when(k % 4 != 0, F.date_add(F.lit("1997-12-20").cast("date"), k)).alias("feed_start_date"),
            F.when(k % 6 != 0, F.lit("1999-06-01").cast("date")).alias("feed_end_date"),
            F.lit(0).cast("bigint").alias("row_ix"),
        )

    @cached_property
    def service(self) -> ServiceModel:
        """Metrics whose steps are kept as tables."""
        return ServiceModel(self, self.workspace)

    @cached_property
    def plans(self) -> ServiceModel:
        """The same metrics as plans only, for queries that read one step."""
        return ServiceModel(self)

    @cached_property
    def agency_metrics(self) -> DataFrame:
        return self.service.agency_metrics(self.feeds)
