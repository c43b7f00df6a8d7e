"""Event-time windows over a stream of event files.

The batch form of the same query is queries.events_hourly; both share ``hourly``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def hourly(events: DataFrame) -> DataFrame:
    """Count of events by type in tumbling one-hour windows."""
    windowed = events.groupBy(F.window("ts", "1 hour"), "event_type").agg(F.count(F.lit(1)).alias("n"))
    return windowed.select(F.col("window.start").alias("hour"), "event_type", "n")


def stream_hourly(spark: SparkSession, folder: str, late: str = "2 hours") -> DataFrame:
    """The streaming form: state of a window is dropped once the watermark has passed it."""
    schema = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"
    return hourly(spark.readStream.schema(schema).parquet(folder).withWatermark("ts", late))
