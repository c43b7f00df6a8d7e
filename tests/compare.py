"""Order-insensitive comparison of a Spark result with the oracle's."""

from __future__ import annotations

import math


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v + 0.0:.9g}")
    if hasattr(v, "asDict"):
        return tuple(norm(x) for x in v)
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    return v


def rows_of(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(norm(r[i]) for i in order) for r in rows), key=repr)


def assert_same(df, con, sql):
    got = rows_of(df.collect(), df.columns)
    rel = con.sql(sql)
    names = list(rel.columns)
    assert sorted(names) == sorted(df.columns)
    want = rows_of(rel.fetchall(), names)
    assert len(got) == len(want)
    assert got == want
