"""As-of and range joins without pairs that are thrown away afterwards."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def asof_join(left: DataFrame, right: DataFrame, by: Sequence[str], at: str, right_at: str) -> DataFrame:
    """Each row of left with the row of right that has the same keys and the greatest ``right_at`` up to ``at``, or NULLs.

    Both sides are laid in one order by key and time and each left row takes the last right row before it: one shuffle and
    one sort, no pairs. A NULL in a key or in a time has no match. Among right rows of one key and time any may be taken.
    """
    carried = [c for c in right.columns if c not in by]
    one = left.select(*[F.col(c).alias(f"__k{i}") for i, c in enumerate(by)], F.col(at).alias("__t"), F.struct(*left.columns).alias("__l"), F.lit(None).cast(right.select(F.struct(*carried).alias("r")).schema["r"].dataType).alias("__r"))
    two = right.filter(F.col(right_at).isNotNull()).select(*[F.col(c).alias(f"__k{i}") for i, c in enumerate(by)], F.col(right_at).alias("__t"), F.lit(None).cast(one.schema["__l"].dataType).alias("__l"), F.struct(*carried).alias("__r"))
    w = Window.partitionBy(*[f"__k{i}" for i in range(len(by))]).orderBy(F.col("__t").asc_nulls_first(), F.col("__l").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    known = F.lit(True)
    for i in range(len(by)):
        known = known & F.col(f"__k{i}").isNotNull()
    found = F.when(known & F.col("__t").isNotNull(), F.last("__r", ignorenulls=True).over(w))
    laid = one.unionByName(two).withColumn("__m", found).filter(F.col("__l").isNotNull())
    return laid.select("__l.*", *[F.col(f"__m.{c}").alias(c) for c in carried])


def range_join(df: DataFrame, ranges: DataFrame, x: str, low: str, high: str, width: float) -> DataFrame:
    """Pairs with low <= x < high. Both sides meet in cells of ``width``, so the join has a hash key instead of all pairs.

    A range is copied to each cell that it touches; choose ``width`` near the ranges' usual length. NULLs match nothing.
    """
    cell = lambda c: F.floor(F.col(c) / F.lit(width)).cast("long")
    laid = ranges.filter(F.col(low) < F.col(high)).withColumn("__cell", F.explode(F.sequence(cell(low), cell(high))))
    pairs = df.withColumn("__cell", cell(x)).join(laid, "__cell")
    return pairs.filter((F.col(x) >= F.col(low)) & (F.col(x) < F.col(high))).drop("__cell")
