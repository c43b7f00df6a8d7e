"""A catalogue entry."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from tidemill.sources import TABLES, Catalog, register


@dataclass(frozen=True)
class Query:
    """spark: SQL text, or a function of the catalog. oracle: SQL text; the same as spark's if left out."""

    name: str
    spark: str | Callable[[Catalog], DataFrame]
    oracle: str = ""

    def __post_init__(self) -> None:
        if not self.oracle and isinstance(self.spark, str):
            object.__setattr__(self, "oracle", self.spark)

    def run(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        if callable(self.spark):
            return self.spark(Catalog(spark, sf_dir))
        used = set(re.findall(r"\w+", self.spark))
        register(spark, sf_dir, *[t for t in TABLES if t in used])
        return spark.sql(self.spark)


def m(column: str) -> str:
    """Exact money: sums of decimals don't depend on the order of the rows."""
    return f"cast({column} as decimal(15,2))"


def total(expr: str) -> str:
    """A sum of exact values, returned as a double."""
    return f"cast(sum({expr}) as double)"


def average(expr: str) -> str:
    return f"cast(sum({expr}) as double) / count({expr})"


def day(column: str) -> str:
    return f"cast({column} as date)"
