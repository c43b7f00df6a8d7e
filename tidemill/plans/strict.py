"""Run a query or fail clearly: read-only statements only, and errors keep their cause."""

from __future__ import annotations

import re

from pyspark.errors import AnalysisException, ParseException
from pyspark.sql import DataFrame, SparkSession

_READ = re.compile(r"\s*(?:/\*.*?\*/|--[^\n]*\n|\s|\()*(select|with|values|from|table|explain)\b", re.IGNORECASE | re.DOTALL)


class UnsupportedQuery(ValueError):
    """The engine won't run this statement; the message says why."""


def _nodes(plan):
    yield plan
    for children in (plan.children(), plan.innerChildren()):
        for i in range(children.size()):
            child = children.apply(i)
            if hasattr(child, "innerChildren"):
                yield from _nodes(child)


def check(text: str, spark: SparkSession | None = None) -> None:
    """Reject what isn't a single read-only query: by its first keyword, then by the commands in its parsed form.

    WITH and FROM may also begin an INSERT. Text that doesn't parse is left for the caller's error.
    """
    if not _READ.match(text):
        raise UnsupportedQuery("only read-only queries (SELECT, WITH, VALUES) are run")
    spark = spark or SparkSession.getActiveSession()
    if spark is None:
        return
    try:
        plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(text)
    except Exception:  # noqa: BLE001  spark.sql says what is wrong with it
        return
    for node in _nodes(plan):
        kind = node.getClass().getSimpleName()
        if kind == "ExplainCommand":
            continue
        if kind.startswith(("Insert", "Overwrite", "Append", "Merge", "Update", "Delete", "Create", "Drop", "Replace")) or kind.endswith("Command"):
            raise UnsupportedQuery(f"only read-only queries are run, not {kind}")


def _loses_order(df: DataFrame) -> bool:
    """A row number without an order: only the optimizer writes one, for a correlated LIMIT that it can't tie to its ORDER BY."""
    plan = df._jdf.queryExecution().optimizedPlan()
    return any(n.getClass().getSimpleName() == "Window" and n.orderSpec().isEmpty() and "row_number()" in n.windowExpressions().toString() for n in _nodes(plan))


def run(spark: SparkSession, text: str, enabled: bool = True, volatile: bool = False, **args: object) -> DataFrame:
    """spark.sql for read-only queries. Named parameters (:name) are bound as literals, never spliced into the text."""
    if not enabled:
        raise UnsupportedQuery("the engine is switched off")
    check(text, spark)
    try:
        df = spark.sql(text, args=args or None)
        if not volatile and not df._jdf.queryExecution().analyzed().deterministic():
            raise UnsupportedQuery("a function of this query gives other values on each run: pass volatile=True to allow that")
        if not volatile and re.search(r"\blimit\b", text, re.IGNORECASE) and _loses_order(df):
            raise UnsupportedQuery("a correlated LIMIT takes any rows unless its ORDER BY columns are selected with it: select them, or use operators.top_per_group")
        return df
    except (ParseException, AnalysisException) as e:
        if re.search(r"\b(any|all|some)\s*\(\s*select", text, re.IGNORECASE):
            raise UnsupportedQuery("op ANY/ALL (subquery) has no SQL syntax here: use operators.quantified") from e
        if re.search(r"distinct\s+on\s*\(", text, re.IGNORECASE):
            raise UnsupportedQuery("DISTINCT ON has no SQL syntax here: use operators.distinct_on") from e
        raise UnsupportedQuery(str(e).splitlines()[0]) from e
