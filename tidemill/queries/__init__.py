"""The query catalogue: each entry has its Spark form and the SQL that an independent engine runs on the same tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemill.queries import aggregates, joins, scans, sets, subqueries, tpch
from tidemill.queries.base import Query

ALL: dict[str, Query] = {q.name: q for module in (scans, joins, aggregates, subqueries, sets, tpch) for q in module.QUERIES}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: q.run for name, q in ALL.items()}


def oracle_sql() -> dict[str, str]:
    return {name: q.oracle for name, q in ALL.items() if q.oracle}
