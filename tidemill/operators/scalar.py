"""Joining one row of totals to every row."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def single_row_join(df: DataFrame, totals: DataFrame) -> DataFrame:
    """df with the columns of an ungrouped aggregate. ``totals`` has one row by construction, so it is broadcast."""
    return df.crossJoin(F.broadcast(totals.agg(*[F.first(c).alias(c) for c in totals.columns])))
