"""The pipeline's stages and its whole run against brute-force versions of the deterministic stages."""

from collections import Counter, defaultdict

import pytest

import corpus_pipeline
from tests.llm.test_minhash import brute
from tidemill.llm import queries
from tidemill.llm.common import stored
from tidemill.llm.lines import LEAST
from tidemill.llm.mixing import copies


def lines_left(texts):
    """Line dedup with one edit, by comparing what is left of each line after one deletion."""
    lines = list(dict.fromkeys(x for _, t in sorted(texts.items()) for x in (t or "").split("\n") if len(x) >= LEAST))
    up = {x: x for x in lines}

    def root(x):
        while up.get(x, x) != x:
            x = up[x]
        return x

    def link(a, b):
        if root(a) != root(b):
            up[root(b)] = root(a)

    by = defaultdict(list)
    for x in lines:
        for i in range(len(x)):
            by[i, x[:i] + x[i + 1 :]].append(x)
            if x[:i] + x[i + 1 :] in up:
                link(x[:i] + x[i + 1 :], x)
    for group in by.values():
        for x in group[1:]:
            link(group[0], x)
    seen, out = set(), {}
    for d, t in sorted(texts.items()):
        keep = []
        for x in (t or "").split("\n"):
            if not x or root(x) not in seen:
                keep.append(x)
            seen.add(root(x))
        if keep:
            out[d] = "\n".join(keep) if t is not None else None
    return out


@pytest.fixture(scope="module")
def steps(spark, small_dir):
    docs, out = spark.read.parquet(f"{small_dir}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        after = stored(stage(spark, docs, small_dir), name)
        out.append((name, docs, after))
        docs = after
    return out


def texts(df):
    return {r["doc_id"]: r["text"] for r in df.collect()}


def test_names_and_columns(steps):
    assert [n for n, _, _ in steps] == ["quality_classifier", "line_dedup", "near_dedup", "mix_sources", "pack_sequences"]
    columns = steps[0][1].columns
    assert all(after.columns == columns for _, _, after in steps[:-1])


def test_quality_stage(spark, small_dir, steps):
    _, before, after = steps[0]
    kept = {r["doc_id"] for r in queries.op5_quality(spark, small_dir).collect() if r["kept"]}
    assert set(texts(after)) == kept and 0 < len(kept) < before.count()


def test_line_stage(steps):
    _, before, after = steps[1]
    assert texts(after) == lines_left(texts(before))


def test_near_stage(steps):
    _, before, after = steps[2]
    groups = brute(texts(before), 5)
    assert set(texts(after)) == {c for _, c in groups.values()}


def test_mixing_stage(steps):
    _, before, after = steps[3]
    want = {r["doc_id"]: r["copies"] for r in copies(before).collect() if r["copies"]}
    assert Counter(r["doc_id"] for r in after.collect()) == Counter(want)


def test_packing_stage(steps):
    _, before, after = steps[4]
    times, per = Counter(r["doc_id"] for r in before.collect()), defaultdict(list)
    for r in after.collect():
        per[r["doc_id"], r["piece"]].append(r)
    assert all(len(rows) == times[d] for (d, _), rows in per.items())
    one = [r for rows in per.values() for r in rows]
    assert {r["doc_id"] for r in one} == set(times)
    bins = defaultdict(int)
    for r in one:
        bins[r["sequence_id"]] += r["length"]
    assert max(bins.values()) <= 4096 and len(bins) <= -(-sum(bins.values()) // 4096) * 1.05 + 1


def test_run_equals_the_stages(spark, small_dir, steps):
    key = lambda r: (r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"])
    assert Counter(map(key, corpus_pipeline.run(spark, small_dir).collect())) == Counter(map(key, steps[-1][2].collect()))


