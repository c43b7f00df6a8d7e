"""Connected components of an edge table by alternating large and small stars.

Every round sends each node's neighbours towards the smallest of them; rounds end when the edges form stars. Edges stay
in tables all the time; the driver sees one bit a round. The smallest neighbour of each node is stored before it is
joined back, so that Spark may split the join at a node with very many neighbours.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.llm.common import drop, stored, within


def _stars(e: DataFrame) -> bool:
    """Whether every node has one smaller neighbour or is the smallest of its own."""
    ends = e.select(F.col("u").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(e.select(F.col("v").alias("x"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    return within(ends.groupBy("x").agg(F.sum("up").alias("up"), F.sum("down").alias("down")).filter("up > 1 or (up > 0 and down > 0)"), 0)


def components(edges: DataFrame) -> DataFrame:
    """(id, component) for every end of edges(a, b); component is the smallest id that can be reached."""
    e = stored(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), "edges")
    while not _stars(e):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = stored(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m")), "large")
        large = stored(both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large_star")
        drop(e, low)
        low = stored(large.groupBy("u").agg(F.min("v").alias("m")), "small")
        small = large.join(low, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = stored(small.unionByName(low.withColumnRenamed("m", "v")).distinct(), "small_star")
        drop(large, low)
    ends = e.select(F.col("u").alias("id"), F.col("v").alias("component"))
    return ends.unionByName(e.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())


def joined_components(found: DataFrame, extra: DataFrame) -> DataFrame:
    """found(id, component) after more links extra(a, b): only the components that these links join are looked at."""
    label = lambda x: found.select(F.col("id").alias(x), F.col("component").alias(f"c{x}"))
    named = extra.join(label("a"), "a", "left").join(label("b"), "b", "left")
    merged = components(named.select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b")))
    merged = merged.select(F.col("id").alias("component"), F.col("component").alias("root"))
    old = found.join(merged, "component", "left").select("id", F.coalesce("root", "component").alias("component"))
    new = merged.select(F.col("component").alias("id"), F.col("root").alias("component")).join(found.select("id"), "id", "left_anti")
    return old.unionByName(new)
