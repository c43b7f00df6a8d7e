"""Compact plan summaries."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame


def _text(df: DataFrame) -> str:
    return df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("simple"))


def operators(df: DataFrame) -> list[str]:
    """Names of the physical operators, top down, as planned before execution."""
    found = []
    for line in _text(df).splitlines():
        m = re.match(r"^[\s:+\-|]*(?:\*\(\d+\)\s*)?([A-Z]\w+)", line)
        if m and not line.startswith("=="):
            found.append(m[1])
    return found


def summary(df: DataFrame, width: int = 100) -> str:
    """The physical plan, one short line an operator, with expression ids removed."""
    lines = []
    for line in _text(df).splitlines():
        if line.strip() and not line.startswith("=="):
            lines.append(re.sub(r"#\d+L?", "", line)[:width].rstrip())
    return "\n".join(lines)


def _below(node):
    """What a physical operator reads; the wrappers of adaptive execution stand for the plan inside them."""
    kind = node.getClass().getSimpleName()
    if kind == "AdaptiveSparkPlanExec":
        return [node.executedPlan()]
    if kind.endswith("QueryStageExec"):
        return [node.plan()]
    children = node.children()
    return [children.apply(i) for i in range(children.size())]


def profile(df: DataFrame) -> list[tuple[int, str, dict[str, int]]]:
    """Run df, throw its rows away, and give (depth, operator, metrics) of the plan that ran, top down.

    The metrics are Spark's own: rows, bytes and times (ms or ns as Spark counts them), summed over all tasks.
    """
    execution = df.sparkSession._jsparkSession.sessionState().executePlan(df._jdf.queryExecution().logical(), df.sparkSession._jvm.org.apache.spark.sql.execution.CommandExecutionMode.ALL())
    execution.toRdd().count()
    out: list[tuple[int, str, dict[str, int]]] = []

    def walk(node, depth: int) -> None:
        found, it = {}, node.metrics().iterator()
        while it.hasNext():
            pair = it.next()
            found[pair._1()] = pair._2().value()
        name = node.nodeName().strip()
        hidden = name.startswith(("AdaptiveSparkPlan", "InputAdapter", "ShuffleQueryStage", "BroadcastQueryStage", "ResultQueryStage"))
        if not hidden:
            out.append((depth, name, {k: v for k, v in sorted(found.items()) if v > 0}))
        for child in _below(node):
            walk(child, depth + (not hidden))

    walk(execution.executedPlan(), 0)
    return out


def explain_analyze(df: DataFrame) -> str:
    """The plan that ran, one line an operator, with its rows and times."""
    return "\n".join("  " * depth + name + "".join(f" {k}={v}" for k, v in found.items() if "Rows" in k or "Time" in k or "time" in k.lower()) for depth, name, found in profile(df))
