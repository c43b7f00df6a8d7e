"""First rows: DISTINCT ON, top-N for each group, FETCH FIRST n WITH TIES."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int = 1) -> DataFrame:
    """The first n rows of each group. Spark prunes each partition to n rows a group before the shuffle (WindowGroupLimit)."""
    rank = "__rank"
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).filter(F.col(rank) <= n).drop(rank)


def distinct_on(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """SELECT DISTINCT ON (keys) ... ORDER BY keys, order."""
    return top_per_group(df, keys, order, 1)


def with_ties(df: DataFrame, order: Sequence[tuple[str, str]], n: int) -> DataFrame:
    """ORDER BY order FETCH FIRST n ROWS WITH TIES; order: (column, 'asc' or 'desc'), NULLs last.

    The n-th row comes from a bounded top-n. Its sort key, one row, is broadcast and the table is filtered
    against it, so the table is neither sorted nor moved to one task.
    """
    if n <= 0 or not order:
        return df.limit(max(n, 0))
    last = [f"__last{i}" for i in range(len(order))]
    forward = [F.desc_nulls_last(c) if way == "desc" else F.asc_nulls_last(c) for c, way in order]
    backward = [F.asc_nulls_first(c) if way == "desc" else F.desc_nulls_first(c) for c, way in order]
    cut = df.orderBy(*forward).limit(n).orderBy(*backward).limit(1).select(*[F.col(c).alias(k) for (c, _), k in zip(order, last, strict=True)])
    before, equal = F.lit(False), F.lit(True)
    for (c, way), k in zip(order, last, strict=True):
        a, b = df[c], F.col(k)
        first = F.coalesce(a > b if way == "desc" else a < b, a.isNotNull() & b.isNull())
        before, equal = before | (equal & first), equal & a.eqNullSafe(b)
    return df.join(F.broadcast(cut), before | equal).select(*[df[c] for c in df.columns])
