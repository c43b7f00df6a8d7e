"""Mixing sources to target weights by pivotal dependent rounding.

Each source has a target in words; every document of it should appear target / source size times, a whole number of
copies plus a fraction. Pivotal rounding pairs two fractional documents and moves words from one to the other, in a
random direction with the odds that keep both expectations, until one of them has a whole number of copies. The words
of a source stay the same at each step, so that only the last fraction of a source is rounded, to the nearer side: a
source's words miss its target by half of one document at most.

Plan: narrow rows (id, source, size) only. Documents are dealt to shards by a hash of their id, never by source, so a
source with a third of all rows is spread like any other. A shard leaves one fractional document a source at most;
those meet in groups of FAN_IN shards, level by level, down to one. The hashes of ids decide everything: reruns agree.

Targets: source sizes are shared out of ``share`` times all words by weight; where a share exceeds ``limit`` times
its source it is cut there and the excess is dealt to the others by weight, until none exceeds.

NULL text counts 0 words, a NULL source is a source of its own (the last). Where ids are NULL or repeated, rows are told
apart by their place in the table instead of by id. Documents without words take 0 words and keep the whole
part of their copies. An empty table gives no rows. ``mix`` carries all other columns along.
"""

from __future__ import annotations

import itertools
import math

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemill.llm.common import distinct_ids, fresh, n_words, ship, stored

WEIGHTS = (5.0, 2.0, 1.0)
SHARE, LIMIT = 1.5, 2.0
SHARD_ROWS = 4096
FAN_IN = 32
_EPS = 1e-9


def levels(sizes: list[float], weights: list[float], total: float, limit: float = LIMIT) -> float:
    """The level L for which sum(min(limit * size, L * weight)) is total; infinite if even the limits don't reach it."""
    caps = [limit * s for s in sizes]
    if total >= sum(caps):
        return math.inf
    order = sorted(range(len(sizes)), key=lambda i: caps[i] / weights[i])
    left, rest = total, math.fsum(weights)
    for i in order:
        if caps[i] / weights[i] * rest >= left:
            return left / rest
        left, rest = left - caps[i], rest - weights[i]
    return math.inf


def source_targets(sized: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, limit: float = LIMIT) -> DataFrame:
    """(source, source_size, target) for each source of sized(source, size).

    Sources are numbered by code point, NULL last, without one task seeing all of them: ranges of sources, the count of
    each range, and the place within the range. The level is found by repeated totals, one row each; a pass fixes the
    sources that are over their limit.
    """
    spark = sized.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    per = sized.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"))
    ranged = stored(per.repartitionByRange(parts, F.col("source").isNull(), F.col("source")).withColumn("part", F.spark_partition_id()), "sources")
    counts = {r["part"]: r["n"] for r in ranged.groupBy("part").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row a partition
    before, seen = [], 0
    for p in sorted(counts):
        before.append((p, seen))
        seen += counts[p]
    if not before:
        return ranged.select("source", "source_size", F.lit(0.0).alias("target")).limit(0)
    start = F.broadcast(spark.createDataFrame(before, "part int, before long"))
    w = Window.partitionBy("part").orderBy(F.col("source").asc_nulls_last())
    numbered = ranged.join(start, "part").withColumn("nth", F.col("before") + F.row_number().over(w) - 1)
    weight = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("nth") % len(weights) + 1).cast("int"))
    table = stored(numbered.select("source", "source_size", weight.alias("weight")), "weights")
    cap = F.lit(float(limit)) * F.col("source_size")
    whole = float(table.agg(F.sum("source_size")).first()[0] or 0) * share
    level, fixed = 0.0, -1
    while True:
        over = (cap <= F.lit(level) * F.col("weight")) if level else (cap <= 0)
        row = table.agg(F.sum(F.when(over, cap).otherwise(0.0)).alias("capped"), F.sum(F.when(over, 0.0).otherwise(F.col("weight"))).alias("rest"), F.count(F.when(over, 1)).alias("n")).first()
        if not row["rest"]:
            level = math.inf
            break
        if row["n"] == fixed:
            break
        fixed, level = row["n"], max(0.0, whole - row["capped"]) / row["rest"]
    target = cap if math.isinf(level) else F.least(cap, F.lit(level) * F.col("weight"))
    return table.select("source", "source_size", target.cast("double").alias("target"))


def _unit(a: int, b: int, seed: int) -> float:
    """A number in [0, 1) from two row hashes (splitmix64)."""
    z = (a * 0x9E3779B97F4A7C15 + b * 0xC2B2AE3D27D4EB4F + seed * 0x165667B19E3779F9) & 0xFFFFFFFFFFFFFFFF
    z = ((z ^ (z >> 30)) * 0xBF58476D1CE4E5B9) & 0xFFFFFFFFFFFFFFFF
    z = ((z ^ (z >> 27)) * 0x94D049BB133111EB) & 0xFFFFFFFFFFFFFFFF
    return ((z ^ (z >> 31)) >> 11) / float(1 << 53)


def pivot(rows: list[tuple[int, int, float]], last: bool, seed: int = 0) -> list[float]:
    """Fractions after pairing all rows (hash, size, fraction) of one source in turn; at most one stays fractional, none if last."""
    x = [f for _, _, f in rows]
    held = -1
    for i, (h, size, _) in enumerate(rows):
        if x[i] <= _EPS or x[i] >= 1 - _EPS:
            x[i] = float(x[i] >= 0.5)
            continue
        if held < 0:
            held = i
            continue
        hj, sj, _ = rows[held]
        up = min((1 - x[held]) * sj, x[i] * size)  # words that can move to the held document
        down = min(x[held] * sj, (1 - x[i]) * size)
        t = up if _unit(h, hj, seed) * (up + down) < down else -down
        x[held] += t / sj
        x[i] -= t / size
        done_held, done_i = not _EPS < x[held] < 1 - _EPS, not _EPS < x[i] < 1 - _EPS
        for k, done in ((held, done_held), (i, done_i)):
            if done:
                x[k] = float(x[k] >= 0.5)
        held = -1 if done_held and done_i else (i if done_held else held)
    if last and held >= 0:
        x[held] = float(x[held] >= 0.5)
    return x


def _round(rows: pa.Table, last: bool, seed: int) -> pa.Table:
    """One shard, or what is left of some: sources apart, each by size and then by hash."""
    col = {c: rows.column(c).to_pylist() for c in ("source", "size", "h", "row", "frac")}
    order = sorted(range(rows.num_rows), key=lambda i: (col["source"][i] is None, col["source"][i] or "", col["size"][i], col["h"][i], col["row"][i]))
    out = list(col["frac"])
    for _, at in itertools.groupby(order, key=lambda i: (col["source"][i] is None, col["source"][i])):
        part = list(at)
        for i, x in zip(part, pivot([(col["h"][i], col["size"][i], col["frac"][i]) for i in part], last, seed), strict=True):
            out[i] = x
    return rows.set_column(rows.schema.get_field_index("frac"), "frac", pa.array(out, pa.float64()))


def _task(last: bool, seed: int):
    return lambda rows: _round(rows, last, seed)


_ROW = "row long, doc_id long, source string, size long, source_size long, target double, h long, whole long, frac double, shard long"


def copies(docs: DataFrame, size: Column | None = None, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, limit: float = LIMIT, seed: int = 0) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies) for each row of docs(doc_id, source, text)."""
    spark = docs.sparkSession
    ship(spark)
    size = n_words(F.col("text")) if size is None else size
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), size.cast("long").alias("size"))
    sized = stored(narrow.withColumn("row", F.monotonically_increasing_id()), "sized")
    n = sized.count()
    key = F.col("doc_id") if distinct_ids(sized) else F.col("row")
    targets = source_targets(sized, weights, share, limit).withColumnRenamed("source", "__s")
    rows = sized.join(stored(targets, "targets"), F.col("source").eqNullSafe(F.col("__s"))).drop("__s")
    shards = 1 << max(0, math.ceil(math.log2(max(1, n / SHARD_ROWS))))
    times = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    rows = rows.withColumn("h", F.xxhash64(key, F.lit(seed))).withColumn("whole", F.floor(times + _EPS).cast("long"))
    frac = F.greatest(F.lit(0.0), times - F.col("whole"))
    rows = rows.withColumn("frac", F.when((F.col("size") > 0) & (frac > _EPS), frac).otherwise(0.0))
    rows = rows.withColumn("shard", F.pmod(F.xxhash64(key, F.lit(seed + 1)), F.lit(shards)))
    done, level = [], 0
    while True:
        last = shards <= 1

        part = stored(rows.select(*[c.split()[0] for c in _ROW.split(", ")]).groupBy("shard").applyInArrow(_task(last, seed + level), _ROW), f"rounded{level}")
        whole = (F.col("frac") == 0) | (F.col("frac") == 1)
        done.append(part.filter(whole))
        if last:
            break
        level, shards = level + 1, -(-shards // FAN_IN)
        rows = part.filter(~whole).withColumn("shard", F.floor(F.col("shard") / FAN_IN).cast("long"))
    out = done[0]
    for p in done[1:]:
        out = out.unionByName(p)
    return out.select("row", "doc_id", "source", "size", "source_size", "target", (F.col("whole") + F.col("frac").cast("long")).alias("copies"))


def mix(docs: DataFrame, **how) -> DataFrame:
    """docs with each row repeated as often as the mix takes it (not at all, once or more), in all its columns."""
    row, n = fresh(docs, "__row", "__n")
    if distinct_ids(docs):
        keyed, got = docs.withColumn(row, F.col("doc_id").cast("long")), copies(docs, **how)
    else:
        keyed = stored(docs.withColumn(row, F.monotonically_increasing_id()), "mixed")
        got = copies(keyed.select(F.col(row).alias("doc_id"), "source", "text"), **how)
    taken = keyed.join(got.filter("copies > 0").select(F.col("doc_id").alias(row), F.col("copies").alias(n)).hint("merge"), row)
    return taken.select(*[F.col(f"`{c}`") for c in docs.columns], F.explode(F.array_repeat(F.lit(1), F.col(n).cast("int"))).alias(n)).drop(n)
