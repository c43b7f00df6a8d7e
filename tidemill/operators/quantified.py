"""x op ANY (subquery) and x op ALL (subquery), which Spark SQL doesn't parse.

ANY keeps a row if some comparison is true. ALL drops a row if some comparison is false or unknown, so
an empty subquery keeps every row and a NULL in it keeps none. Uncorrelated ordering comparisons need
only the least and the greatest value of the subquery, so they become one aggregate row instead of a join.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_OPS = {"=": "__eq__", "<>": "__ne__", "<": "__lt__", "<=": "__le__", ">": "__gt__", ">=": "__ge__"}


def quantified(df: DataFrame, x: Column, op: str, how: str, sub: DataFrame, value: str, on: Sequence[tuple[str, str]] = ()) -> DataFrame:
    """Rows of df for which ``x op ANY|ALL (SELECT value FROM sub WHERE df.a = sub.b ...)`` is true.

    on: pairs (column of df, column of sub) that correlate the two sides.
    """
    how = how.upper()
    if op not in _OPS or how not in ("ANY", "ALL"):
        raise ValueError(f"{op} {how} isn't a quantified comparison")
    keys = [f"__s{i}" for i in range(len(on))]
    side = sub.select(F.col(value).alias("__v"), *[F.col(b).alias(k) for (_, b), k in zip(on, keys, strict=True)])
    if op in ("<", "<=", ">", ">="):
        return _by_bounds(df, x, op, how, side, [a for a, _ in on], keys)
    if op == "=" and how == "ANY":
        match = x == F.col("__v")
        for (a, _), k in zip(on, keys, strict=True):
            match = match & (F.col(a) == F.col(k))
        return df.join(side, match, "left_semi")
    return _by_equality(df, x, op, how, side, [a for a, _ in on], keys)


def _by_bounds(df: DataFrame, x: Column, op: str, how: str, side: DataFrame, outer: list[str], keys: list[str]) -> DataFrame:
    """x < ANY is x < max, x < ALL is x < min, unless NULLs leave the comparison unknown."""
    far = F.max if (op[0] == "<") == (how == "ANY") else F.min
    stats = side.groupBy(*keys).agg(far("__v").alias("__bound"), F.count(F.lit(1)).alias("__n"), F.count("__v").alias("__known"))
    own = df.columns
    if keys:
        cond = F.lit(True)
        for a, k in zip(outer, keys, strict=True):
            cond = cond & (df[a] == F.col(k))
        joined = df.join(stats, cond, "left")
    else:
        joined = df.crossJoin(F.broadcast(stats))  # one row
    true = F.coalesce(getattr(x, _OPS[op])(F.col("__bound")), F.lit(False))
    if how == "ANY":
        keep = true
    else:
        keep = F.coalesce(F.col("__n"), F.lit(0)).eqNullSafe(0) | (true & (F.col("__n") == F.col("__known")))
    return joined.filter(keep).select(*[df[c] for c in own])


def _by_equality(df: DataFrame, x: Column, op: str, how: str, side: DataFrame, outer: list[str], keys: list[str]) -> DataFrame:
    """x = ALL, x <> ANY and x <> ALL: one row of totals a key, and for <> ALL an anti join on the value itself."""
    stats = side.groupBy(*keys).agg(F.min("__v").alias("__low"), F.max("__v").alias("__high"), F.count(F.lit(1)).alias("__n"), F.count("__v").alias("__known"))
    own, match = df.columns, F.lit(True)
    for a, k in zip(outer, keys, strict=True):
        match = match & (df[a] == F.col(k))
    joined = df.join(stats, match, "left") if keys else df.crossJoin(F.broadcast(stats))  # one row
    none, whole = F.coalesce(F.col("__n"), F.lit(0)) == 0, F.col("__n") == F.col("__known")
    same = (x == F.col("__low")) & (x == F.col("__high"))
    if op == "=":  # ALL
        return joined.filter(none | F.coalesce(whole & same, F.lit(False))).select(*[df[c] for c in own])
    if how == "ANY":
        return joined.filter(F.coalesce(~same, F.lit(False))).select(*[df[c] for c in own])
    kept = joined.filter(none | (whole & x.isNotNull())).select(*[df[c] for c in own])
    differ = x == F.col("__v")
    for a, k in zip(outer, keys, strict=True):
        differ = differ & (F.col(a) == F.col(k))
    return kept.join(side.filter(F.col("__v").isNotNull()), differ, "left_anti")
