"""Numbering rows of a group in order without gathering the group, and dealing rows that grow afterwards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def running_number(
    df: DataFrame, keys: list[str], order: list[Column], block: Column, name: str
) -> DataFrame:
    """Number the rows of each key from 1 in the given order.

    ``block`` rises with the order (equal inside a range of it). Only a block is
    sorted by one task; where a block starts follows from the block sizes. A
    very large key is so spread over as many tasks as it has blocks.
    """
    blocked = df.withColumn("_block", block)
    sizes = blocked.groupBy(*keys, "_block").agg(F.count("*").alias("_size"))
    earlier = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(*keys, "_block", F.coalesce(F.sum("_size").over(earlier), F.lit(0)).alias("_start"))
    inside = Window.partitionBy(*keys, "_block").orderBy(*order)
    return (
        blocked.join(starts, [*keys, "_block"])
        .withColumn(name, F.col("_start") + F.row_number().over(inside))
        .drop("_block", "_start")
    )


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """Rows dealt by ``keys`` over as many tasks as a shuffle has.

    For rows that are expanded and counted again under the same keys: the expanded rows need no shuffle then. Spark
    would merge the tasks by the size that the rows have before.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)
