"""Session factory with the settings the engine is designed for."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: UTC and ANSI fix the semantics; AQE re-plans joins, merges small partitions and splits skewed ones at run time.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.ui.showConsoleProgress": "false",
}


def session(master: str | None = None, shuffle_partitions: int | None = None, **extra: str) -> SparkSession:
    """A session with SETTINGS. On a cluster leave ``master`` to spark-submit.

    ``shuffle_partitions`` is a starting count that AQE merges down; leave it unset to keep the cluster's own.
    """
    builder = SparkSession.builder.appName("tidemill")
    if master:
        builder = builder.master(master)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return builder.config(map=SETTINGS | extra).getOrCreate()
