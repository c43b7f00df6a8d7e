"""Mixing: targets against a plain computation, whole copies, words near targets."""

import math
from collections import defaultdict

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemill.llm.mixing import copies, levels, mix, pivot


def plain_targets(sizes, weights, share=1.5, limit=2.0):
    total, fixed, out = share * sum(sizes.values()), {}, {}
    while True:
        rest = {s: weights[s] for s in sizes if s not in fixed}
        left = total - sum(fixed.values())
        out = fixed | {s: left * w / sum(rest.values()) for s, w in rest.items()}
        over = [s for s in rest if out[s] > limit * sizes[s] + 1e-9]
        if not over:
            return out
        fixed |= {s: limit * sizes[s] for s in over}


def test_targets_and_words(spark, docs):
    rows = copies(docs).collect()
    sizes = defaultdict(int)
    for r in rows:
        sizes[r["source"]] += r["size"]
    order = sorted(sizes, key=lambda s: s.encode())
    want = plain_targets(sizes, {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)})
    taken, largest = defaultdict(int), defaultdict(int)
    for r in rows:
        assert math.isclose(r["target"], want[r["source"]], rel_tol=1e-9) and r["source_size"] == sizes[r["source"]]
        assert 0 <= r["copies"] <= 2
        taken[r["source"]] += r["size"] * r["copies"]
        largest[r["source"]] = max(largest[r["source"]], r["size"])
    assert all(abs(taken[s] - want[s]) <= largest[s] / 2 + 1 for s in order)


def test_reruns_and_layouts_agree(spark, docs):
    one = {(r["doc_id"], r["copies"]) for r in copies(docs).collect()}
    assert one == {(r["doc_id"], r["copies"]) for r in copies(docs.repartition(13)).collect()}


def test_mix_repeats_rows(spark, docs):
    want = {r["doc_id"]: r["copies"] for r in copies(docs).collect()}
    got = {r["doc_id"]: r["count"] for r in mix(docs).groupBy("doc_id").count().collect()}
    assert got == {d: n for d, n in want.items() if n}


def test_hot_source_over_levels(spark):
    docs = spark.range(20_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("s"), F.col("id") % 7)).alias("source"), F.repeat(F.lit("w "), (F.col("id") % 90 + 1).cast("int")).alias("text"))
    rows = copies(docs).groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("taken"), F.first("target").alias("target")).collect()
    assert all(abs(r["taken"] - r["target"]) <= 46 for r in rows)


@given(st.lists(st.tuples(st.integers(1, 1000), st.floats(0.01, 0.99)), min_size=1, max_size=40))
@settings(deadline=None)
def test_pivot_keeps_words(pairs):
    rows = [(i * 7919, s, f) for i, (s, f) in enumerate(pairs)]
    out = pivot(rows, last=False)
    assert sum(not (x in (0.0, 1.0)) for x in out) <= 1
    assert math.isclose(sum(s * x for (_, s, _), x in zip(rows, out, strict=True)), sum(s * f for s, f in pairs), rel_tol=1e-6, abs_tol=1e-3)


def test_levels():
    assert levels([10, 10], [1, 1], 100) == math.inf
    assert math.isclose(levels([10, 100], [1, 1], 50), 30)
