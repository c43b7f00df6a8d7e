"""Line dedup against plain edit distances."""

import random

import pytest
from pyspark.sql import functions as F

from tests.llm.conftest import write
from tidemill.llm import queries
from tidemill.llm.lines import LEAST, deduplicate_lines, edit_within, join_keys, stripped


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def mutated(rng, s, k, letters="abé"):
    s = list(s)
    for _ in range(k):
        i = rng.randrange(len(s) + 1)
        how = rng.randrange(3)
        if how == 0:
            s.insert(i, rng.choice(letters))
        elif s and how == 1:
            s.pop(min(i, len(s) - 1))
        elif s:
            s[min(i, len(s) - 1)] = rng.choice(letters)
    return "".join(s)


@pytest.mark.parametrize("edits", [1, 2, 3])
def test_distance_and_keys(spark, edits):
    rng = random.Random(edits)
    rows = []
    for _ in range(600):
        a = "".join(rng.choice("abé") for _ in range(rng.choice([0, 1, 2, 5, 12, 33])))
        rows.append(tuple(sorted((a, mutated(rng, a, rng.randrange(6))), key=len)))
    df = spark.createDataFrame(rows, "a string, b string")
    own = F.transform(F.filter(join_keys(F.col("a"), F.length("a"), edits), lambda x: x["own"]), lambda x: x["sk"])
    probes = F.transform(join_keys(F.col("b"), F.length("b"), edits), lambda x: x["sk"])
    df = df.withColumn("rest", stripped(F.col("a"), F.col("b")))
    short = edit_within(F.col("rest.a"), F.col("rest.b"), edits).alias("short")
    for r in df.select("a", "b", "rest", short, edit_within(F.col("a"), F.col("b"), edits).alias("near"), F.arrays_overlap(own, probes).alias("met")).collect():
        assert r["near"] == r["short"] == (distance(r["a"], r["b"]) <= edits)
        x, y = r["rest"]
        assert not (x and y) or (x[0] != y[0] and x[-1] != y[-1])
        if r["near"] and len(r["a"]) > 2 * edits:
            assert r["met"]


def plain(docs, edits):
    lines = list(dict.fromkeys(x for _, t in sorted(docs) for x in (t or "").split("\n") if len(x) >= LEAST))
    label = {x: x for x in lines}

    def root(x):
        while label.get(x, x) != x:
            x = label[x]
        return x

    for i, a in enumerate(lines):
        for b in lines[i + 1 :]:
            if abs(len(a) - len(b)) <= edits and root(a) != root(b) and distance(a, b) <= edits:
                label[root(b)] = root(a)
    seen, out = set(), {}
    for d, t in sorted(docs):
        keep = []
        for x in (t or "").split("\n"):
            if x:
                if root(x) in seen:
                    continue
                seen.add(root(x))
            keep.append(x)
        if keep:
            out[d] = "\n".join(keep) if t is not None else None
    return out


@pytest.mark.parametrize("edits", [1, 2])
def test_against_plain_links(spark, edits):
    """Chains of small edits, a hot line, lines that share segments without being near, short lines."""
    rng = random.Random(9)
    base = ["".join(rng.choice("abcdefghij ") for _ in range(rng.randrange(LEAST, 60))) for _ in range(12)]
    pool = ["x" * 10, *base]
    for b in base[:6]:
        x = b
        for _ in range(6):
            x = mutated(rng, x, rng.choice([1, 1, 2, 4]), "abcdefghij")
            pool.append(x)
    for _ in range(25):  # one half in common, the other not
        pool.append(base[0][:20] + "".join(rng.choice("klmnop") for _ in range(len(base[0]) - 20)))
    docs = [(d, "\n".join([base[1], *[rng.choice(pool) for _ in range(rng.randrange(6))]])) for d in range(40)] + [(41, ""), (42, None), (43, base[1]), (44, "short")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert {r["doc_id"]: r["text"] for r in deduplicate_lines(df, edits).collect()} == plain(docs, edits)


def test_wide_query_takes_out_lines_within_three_edits(spark, tmp_path):
    rng = random.Random(3)
    base = ["".join(rng.choice("abcdefghij ") for _ in range(40)) for _ in range(8)]
    far = "".join("klmnopqrst"[i % 10] if i in (3, 14, 25, 36) else c for i, c in enumerate(base[0]))
    near = ["".join("z" if i in (2, 17, 33) else c for i, c in enumerate(b)) for b in base]
    docs = [(1, "\n".join(base)), (2, "\n".join([*near, far])), (3, "\n".join(base[1:3]))]
    assert all(distance(a, b) == 3 for a, b in zip(base, near, strict=True)) and min(distance(far, x) for x in (base[0], near[0])) > 3
    sf_dir = write(tmp_path / "t", [{"doc_id": d, "text": t} for d, t in docs])
    got = {r["doc_id"]: r["text"] for r in queries.op7_line_dedup_wide(spark, sf_dir).collect()}
    assert got == {1: docs[0][1], 2: far, 3: None}
    assert {d: t for d, t in got.items() if t is not None} == plain(docs, 3)


def test_short_lines_that_are_equal(spark, tmp_path):
    docs = [(1, "All rights reserved.\n\nAll rights reserved\n"), (2, "All rights reserved.\n\nown"), (3, "All rights reserved."), (4, "own"), (5, "\n"), (6, None)]
    sf_dir = write(tmp_path / "t", [{"doc_id": d, "text": t} for d, t in docs])
    got = {r["doc_id"]: (r["n_dropped"], r["text"]) for r in queries.op7_line_dedup_wide(spark, sf_dir).collect()}
    assert got == {1: (0, docs[0][1]), 2: (1, "\nown"), 3: (1, None), 4: (1, None), 5: (0, "\n"), 6: (0, None)}
