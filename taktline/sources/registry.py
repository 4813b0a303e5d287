"""Feed catalogue: the JSON envelope and its public snapshot."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from taktline.constants import REGISTRY_PRIVATE_COLUMNS
from taktline.functions import parse_date3
from taktline.operators.digest import table_digest
from taktline.schemas import REGISTRY_ENVELOPE

DATES = ("latest_feed_start_date", "latest_feed_end_date", "feed_discontinued_date")


def parse_registry(documents: DataFrame, column: str = "value") -> DataFrame:
    """One row per feed; a document without code 200 and a list is an error."""
    envelope = documents.select(F.from_json(column, REGISTRY_ENVELOPE).alias("e"))
    usable = (F.col("e.code") == 200) & F.col("e.body").isNotNull()
    body = F.when(usable, F.col("e.body")).otherwise(
        F.raise_error(F.lit("unexpected registry response")).cast(REGISTRY_ENVELOPE["body"].dataType)
    )
    return envelope.select(F.inline(body)).withColumns({d: parse_date3(F.col(d)) for d in DATES})


def read_registry(spark: SparkSession, path: str) -> DataFrame:
    """Catalogue files, one envelope per file."""
    return parse_registry(spark.read.text(path, wholetext=True))


def registry_counts(registry: DataFrame) -> DataFrame:
    """Records, distinct feed pairs and publishers."""
    pairs = registry.groupBy("organization_id", "feed_id").agg(F.count("*").alias("n"))
    publishers = pairs.groupBy("organization_id").agg(F.count("*").alias("pairs"), F.sum("n").alias("n"))
    return publishers.agg(
        F.sum("n").alias("records"), F.sum("pairs").alias("feed_pairs"), F.count("*").alias("publishers")
    )


def registry_redact(registry: DataFrame) -> DataFrame:
    """Public snapshot: no contact and free-form columns."""
    return registry.drop(*REGISTRY_PRIVATE_COLUMNS)


def redaction_summary(registry: DataFrame) -> DataFrame:
    """Row count and checksum that go with the snapshot."""
    return table_digest(registry_redact(registry))
