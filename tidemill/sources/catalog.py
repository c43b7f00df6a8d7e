"""Parquet tables under one directory, read lazily and registered as views by name.

Only Spark's readers touch the path, so any file system that Spark can open will do.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table as a DataFrame; nothing is read until an action needs it."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def register(spark: SparkSession, sf_dir: str, *names: str) -> None:
    """Register the named tables (all by default) as temporary views."""
    for name in names or TABLES:
        read_table(spark, sf_dir, name).createOrReplaceTempView(name)


class Catalog:
    """Tables of one directory as attributes: ``Catalog(spark, d).lineitem``."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name not in TABLES:
            raise AttributeError(name)
        return read_table(self.spark, self.sf_dir, name)
