"""Readers that prune to the columns asked for."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NAMES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def ndjson_line(spark: SparkSession, path: str, uuid: str) -> DataFrame:
    """The line whose top-level uuid is this one, verbatim; a substring test comes first."""
    lines = spark.read.text(path)
    return lines.where(F.col("value").contains(uuid)).where(F.get_json_object("value", "$.uuid") == uuid)
