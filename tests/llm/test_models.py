"""Language identification, the quality classifier and LM scoring."""

import math
import re
import tracemalloc
import zlib
from collections import Counter
from functools import partial

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemill.llm import gru, langid, ngrams, quality, queries
from tidemill.llm.gru import Gru


def held(d, n):
    return zlib.crc32(str(d).encode()) % n == 0


def test_language_held_out_accuracy(spark, docs, small_dir):
    truth = {r["doc_id"]: r["lang"] for r in docs.collect()}
    rows = queries.op4_language_id(spark, small_dir).collect()
    assert all(r["held_out"] == held(r["doc_id"], 5) and 0 <= r["score"] <= 1 for r in rows)
    out = [r["lang_pred"] == truth[r["doc_id"]] for r in rows if r["held_out"]]
    assert sum(out) >= 0.95 * len(out)


def test_language_without_letters_or_training(spark):
    df = spark.createDataFrame([(1, None, "en"), (2, "12 34", "en"), (3, "the cat", "en"), (4, "le chat", "fr")], "doc_id long, text string, lang string")
    got = {r["doc_id"]: r["lang_pred"] for r in langid.predict(df, langid.train(df), F.lit(False)).collect()}
    assert got == {1: "und", 2: "und", 3: "en", 4: "fr"}
    model = langid.train(df.withColumn("lang", F.lit(None).cast("string")))
    assert {r["lang_pred"] for r in langid.predict(df, model, F.lit(False)).collect()} == {"und"}


def test_language_against_plain_naive_bayes(spark, docs):
    """Every n-gram by itself, and every language at once; the operator in blocks of one, two and all languages."""
    rows = [(r["doc_id"], r["text"], r["lang"]) for r in docs.orderBy("doc_id").collect()][:60]
    rows += [(90, "même", "a1"), (91, "même", "b2"), (92, "même", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)

    def grams(text):
        t = f" {text.lower()} "
        for n in ngrams.ORDERS:
            for i in range(len(t) - n + 1):
                yield int(ngrams.hashes(np.array([ord(c) for c in t[i : i + n]], np.uint32), n, langid.BITS)[0])

    seen = [(d, list(grams(t)), lang) for d, t, lang in rows]
    count = {lang: Counter() for lang in sorted({x for _, _, x in seen if x is not None})}
    for _, g, lang in seen:
        if lang is not None:
            count[lang].update(g)
    size = {lang: sum(c.values()) + langid.SMOOTHING * (1 << langid.BITS) for lang, c in count.items()}
    want = {}
    for d, g, _ in seen:
        score = {lang: sum(math.log((c[b] + langid.SMOOTHING) / size[lang]) for b in g) for lang, c in count.items()}
        best = max(score, key=score.get)
        want[d] = best, 1 / sum(math.exp(x - score[best]) for x in score.values())
    assert want[92][0] == "a1" and abs(want[92][1] - 0.5) < 0.1
    model = langid.train(df.select("lang", "text"))
    for block in (1, 2, langid.BLOCK):
        got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.predict(df, model, F.lit(False), block).collect()}
        assert got.keys() == want.keys()
        for d, (lang, p) in want.items():
            assert got[d][0] == lang and math.isclose(got[d][1], p, rel_tol=1e-2)


def test_ngram_blocks_agree():
    rng = np.random.default_rng(0)
    texts = ["".join(rng.choice(list("abcdé "), 3000)), "x", "", "abc" * 500]
    tables = rng.random((2, 1 << 10)).astype(np.float32)
    whole, n = ngrams.sums(texts, tables, 10)
    cut, m = ngrams.sums(texts, tables, 10, block=333)
    assert np.allclose(whole, cut) and (n == m).all()
    for t, s in zip(texts, whole, strict=True):
        assert math.isclose(float((ngrams.counts(t, 10) * tables[0]).sum()), s[0], rel_tol=1e-5)


def test_quality_on_labels(spark):
    sf = "/root/testdata/sf0.01"
    truth = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = queries.op5_quality(spark, sf).collect()
    out = [(r["kept"], truth[r["doc_id"]] == 1) for r in rows if r["doc_id"] in truth]
    good = [k for k, g in out if g]
    bad = [k for k, g in out if not g]
    assert sum(good) >= 0.98 * len(good) and sum(bad) <= 0.15 * len(bad)


def test_quality_without_both_classes(spark, docs):
    one = docs.select("doc_id", F.lit(1).alias("quality"))
    assert quality.keep_good(docs, one).count() == docs.count()
    assert quality.keep_good(docs, one.limit(0)).count() == docs.count()


def test_calibration_and_views():
    rng = np.random.default_rng(1)
    y = (rng.random(600) < 0.8).astype(float)
    text = rng.standard_normal((600, 5)) + y[:, None]
    meta = rng.standard_normal((600, 3)) + 0.5 * y[:, None]
    fold = np.arange(600) % 4 == 0
    given = {"text": (text[:5].astype("f4"), y[:5]), "meta": (meta[:0].astype("f4"), y[:0])}
    m = quality.co_train(text.astype("f4"), meta.astype("f4"), y, np.ones(600), fold, math.log(4), lambda model, n: given)
    p = m.combine(m.text.logit(text), m.meta.logit(meta))
    assert ((p > 0.5) == (y > 0.5)).mean() > 0.85 and abs(p.mean() - y.mean()) < 0.1


def test_co_training_holds_few_matrices(monkeypatch):
    """All of it at once: the drawn documents and one matrix to fit on, no further copy of either."""
    monkeypatch.setattr(quality, "fit", partial(quality.fit, steps=2))
    rng = np.random.default_rng(2)
    y = np.arange(1600) % 2.0
    sample = lambda y: {"text": rng.random((len(y), quality.TEXT), np.float32) + y[:, None].astype("f4"), "meta": rng.random((len(y), quality.META), np.float32)}
    views, sizes = sample(y), []

    def draw(model, n):
        more = np.arange(n) % 2.0
        sizes.append(n)
        return {v: (x, more) for v, x in sample(more).items()}

    tracemalloc.start()
    quality.co_train(views["text"], views["meta"], y, np.ones(1600), np.arange(1600) % 4 == 0, 0.0, draw)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(sizes) == quality.ROUNDS and most < 2 * (1200 + sizes[-1]) * quality.TEXT * 4


def test_quality_sends_the_driver_packed_features(spark, docs):
    """What the driver unpacks is each row's features, and what it is sent is smaller."""
    ids = [r["doc_id"] for r in docs.orderBy("doc_id").limit(40).collect()]
    packed = quality._features(quality._inputs(docs), ids)
    rows = {r["doc_id"]: r for r in docs.collect()}
    assert sorted(packed) == ids and sum(map(len, packed.values())) < 40 * 4 * (quality.TEXT + quality.META) / 2
    assert (quality._unpacked(packed, ids, "text") == np.stack([quality._text_features(rows[i]["text"]) for i in ids])).all()
    assert (quality._unpacked(packed, ids, "meta") == np.stack([quality.meta_features(rows[i]["source"], rows[i]["lang"], rows[i]["n_chars"]) for i in ids])).all()


def test_quality_against_plain_co_training(spark, monkeypatch):
    """Each document by itself, one view after the other; the pool is every document without a label."""
    monkeypatch.setattr(quality, "SURE", 0.8)
    rng = np.random.default_rng(5)
    rows = []
    for i in range(150):
        good = i % 3 != 0
        text = " ".join(rng.choice(["river", "mountain", "history", "letter"] if good else ["buy", "now", "cheap", "cheap"], int(rng.integers(3, 40))))
        rows.append((i, text, "en", ["a", "b"][int(good) if i % 10 else 0], len(text)))
    rows += [(200, rows[1][1], "en", "b", 9), (200, None, None, None, None), (None, "river history", "en", "b", 13)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    labels = {i: int(i % 3 != 0) for i in range(60)}
    model = quality.train(docs, spark.createDataFrame(list(labels.items()), "doc_id long, quality int"))

    def view(row):
        _, text, lang, source, n = row
        t, words = f" {text or ''} ", (text or "").split()
        c = np.zeros(1 << quality.BITS)
        for k in ngrams.ORDERS:
            for i in range(len(t) - k + 1):
                c[ngrams.hashes(np.array([ord(x) for x in t[i : i + k]], np.uint32), k, quality.BITS)[0]] += 1
        same = [sum(a == b for a, b in zip(words[g:], words, strict=False)) / max(1, len(words)) for g in quality.LAGS]
        return c, same, quality.meta_features(source, lang, n)

    known = [view(r) for r in rows if r[0] in labels]
    y = np.array([labels[r[0]] for r in rows if r[0] in labels], float)
    share = 1 / len(y) * np.ones(len(y))
    mean = sum(c / max(1, c.sum()) for c, _, _ in known) / len(known)
    frequency = lambda c, same: np.append((c + quality.SHRINK * mean) / (c.sum() + quality.SHRINK), same).astype("f4")
    sigmoid = lambda z: 1 / (1 + math.exp(-z))
    pool = [view(r) for r in rows if r[0] not in labels]
    drawn = []

    def draw(m, n):
        out = {"text": ([], []), "meta": ([], [])}
        seen = set()
        for c, same, meta in pool:
            f = frequency(c, same)
            p = {"text": sigmoid(m.text.logit(f)), "meta": sigmoid(m.meta.logit(meta))}
            scores = round(p["text"], 6), round(p["meta"], 6)
            if scores in seen:
                continue
            seen.add(scores)
            for v, other, x in (("text", "meta", f), ("meta", "text", meta)):
                if p[other] >= quality.SURE or p[other] <= 1 - quality.SURE:
                    out[v][0].append(x)
                    out[v][1].append(float(p[other] >= 0.5))
        drawn.append(len(out["text"][1]) + len(out["meta"][1]))
        return {v: (np.array(x, "f4").reshape(len(x), -1) if x else np.zeros((0, {"text": quality.TEXT, "meta": quality.META}[v]), "f4"), np.array(z)) for v, (x, z) in out.items()}

    x = np.array([frequency(c, same) for c, same, _ in known])
    fold = np.array([held(r[0], 4) for r in rows if r[0] in labels])
    want = quality.co_train(x, np.array([m for _, _, m in known]), y, share, fold, math.log(y.sum() / (1 - y).sum()), draw)
    assert len(drawn) == quality.ROUNDS and min(drawn) > 50
    scored = {(r["doc_id"], round(r["score"], 2)) for r in quality.score(docs, model).collect()}
    plain = {(r[0], round(float(want.combine(want.text.logit(frequency(*view(r)[:2])), want.meta.logit(view(r)[2]))), 2)) for r in rows}
    near = lambda a, b: all(any(d == e and abs(p - q) <= 0.021 for e, q in b) for d, p in a)
    assert near(scored, plain) and near(plain, scored)


def test_quality_pool_counts_copies_once_and_takes_all_rows(spark):
    rows = [(i, 0.99, 0.5) for i in range(500)] + [(i, 0.98 + i * 1e-5, 0.5) for i in range(500, 900)] + [(900, 0.5, 0.01)]
    scored = spark.createDataFrame(rows, "doc_id long, text_score double, meta_score double").repartition(4)
    got = quality.picks(scored, 50).collect()
    assert sum(r["doc_id"] < 500 for r in got) <= 1 and sum(r["view"] == "text" for r in got) == 50
    assert [(r["label"], r["doc_id"]) for r in got if r["view"] == "meta"] == [(0, 900)]
    assert {r["doc_id"] for r in quality.picks(scored, 1000).collect()} == {0, *range(500, 900), 900}


def test_gru_gradients():
    g = Gru(10, 4, members=4)
    g.p = {k: v.astype(np.float64) for k, v in g.p.items()}
    rng = np.random.default_rng(0)
    x, y, h = rng.integers(0, 10, (3, 5)), rng.integers(0, 10, (3, 5)), rng.standard_normal((3, 4))
    _, grads, _ = g._window(x, y, h, 0)
    for k, v in g.p.items():
        flat, want = v.reshape(-1), grads[k].reshape(-1)
        for i in rng.integers(0, len(flat), 5):
            keep = flat[i]
            flat[i] = keep + 1e-5
            up = g._window(x, y, h, 0)[0]
            flat[i] = keep - 1e-5
            down = g._window(x, y, h, 0)[0]
            flat[i] = keep
            assert abs((up - down) / 2e-5 - want[i]) < 1e-6


def test_gru_windows_equal_one_by_one_and_sum_to_one():
    g = Gru(10, 4, members=4)
    rng = np.random.default_rng(3)
    docs = [np.append(rng.integers(1, 10, n), 0) for n in (3, 0, 7, 40, 12)]

    def plain(d):
        h, last, s = np.zeros((1, 4), np.float32), np.array([0]), 0.0
        for t in d:
            h = g.step(last, h * (last != 0)[:, None])[0]
            s += g.log_probs(h, np.array([t]))[0]
            last = np.array([t])
        return s

    assert np.allclose(g.score(docs, 0, lanes=2, window=4), [plain(d) for d in docs], atol=1e-4)
    h = rng.standard_normal((1, 4)).astype(np.float32)
    assert math.isclose(np.exp([g.log_probs(h, np.array([t]))[0] for t in range(10)]).sum(), 1, rel_tol=1e-5)


def test_gru_learns():
    g = Gru(8, 8, members=4)
    losses = g.train(np.tile([1, 2, 3, 4, 5, 0], 2000), 0, lanes=8)
    assert np.mean(losses[-5:]) < 0.3 * losses[0]


def test_lm_base_score_against_counts(spark, docs, small_dir):
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    tokens = {d: [*re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")), None] for d, t in texts.items()}
    count = Counter(w for d, ws in tokens.items() if not held(d, 10) for w in ws)
    n, v = sum(count.values()), len(count)
    rows = queries.op8_lm_score(spark, small_dir).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ws = tokens[r["doc_id"]]
        want = sum(math.log10((count[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws)
        assert math.isclose(r["base_score"], want, rel_tol=1e-9)
        assert (r["n_tokens"], r["n_known"], r["train_tokens"], r["held_out"]) == (len(ws), sum(count[w] > 0 for w in ws), n, held(r["doc_id"], 10))
        assert r["score"] < 0
    out = [r for r in rows if r["held_out"]]
    assert sum(r["score"] for r in out) > sum(r["base_score"] for r in out)


def test_gru_trains_on_every_training_document(spark):
    """The first 1,500 documents by the hash of their id have words in random order; the order is in the others only."""
    rng = np.random.default_rng(2)
    ids = [r["i"] for r in spark.range(3000).select(F.col("id").alias("i")).orderBy(F.xxhash64("i"), "i").collect()]
    words = list("abcdef")
    ordered = " ".join(words * 10)
    rows = [(i, " ".join(rng.choice(words, 60)) if at < 1500 else ordered) for at, i in enumerate(ids)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    head = gru.head_of(gru.word_counts(docs))
    model, tokens = gru.train(docs, head)
    assert tokens == head.total == 3000 * 61
    streams, _ = gru._streams(head, [ordered, " ".join(rng.choice(words, 60))])
    right, wrong = model.score(streams, head.end)
    assert right > wrong + 20


def test_gru_stream_without_remainder_and_vocabulary_that_grows():
    g = Gru(8, 8, members=4)
    before = g.p["x"].copy()
    g.train(np.array([1, 2, 3, 4, 5, 6, 7, 0, 1, 2, 0]), 0, lanes=4)
    assert (np.abs(g.p["x"] - before).max(axis=1) > 0)[[1, 2, 3, 4, 5, 6, 7]].all()
    assert gru.classes_for(4_000_000) == (48, 32)
    sizes = [math.prod(gru.classes_for(n)) for n in (10**6, 10**8, 10**10)]
    assert sizes[0] < sizes[1] < sizes[2]


def test_gru_late_steps_share_outputs(monkeypatch):
    """One document is much longer than the others: its lone steps are gathered, and nothing is left out or scored twice."""
    g, calls = Gru(10, 4, members=4), []
    rng = np.random.default_rng(4)
    docs = [np.append(rng.integers(1, 10, n), 0) for n in (2000, *[7] * 30)]
    want = [g.score([d], 0, lanes=1, window=1 << 20)[0] for d in docs]
    plain = Gru.log_probs
    monkeypatch.setattr(Gru, "log_probs", lambda self, s, y: calls.append(len(y)) or plain(self, s, y))
    assert np.allclose(g.score(docs, 0, lanes=16, window=8), want, atol=1e-3)
    assert sum(calls) == sum(map(len, docs))
    assert len(calls) <= sum(map(len, docs)) // (16 * 8) + 1


def test_gru_shifted_logits():
    g = Gru(10, 4, members=4)
    g.p["bo"] += np.arange(12, dtype=np.float32).reshape(3, 4) * 100
    g.p["bc"] += np.float32([0, 500, 100])
    h = np.random.default_rng(5).standard_normal((3, 4)).astype(np.float32)
    assert np.allclose([np.exp([g.log_probs(x[None], np.array([t]))[0] for t in range(10)]).sum() for x in h], 1)


@pytest.mark.parametrize("n", [1, 2, 3000])
def test_head_finds_words_as_a_binary_search(n):
    rng = np.random.default_rng(n)
    hashes = np.unique(np.concatenate((rng.integers(0, 1 << 64, n, dtype=np.uint64), rng.integers(0, 99, n // 2, dtype=np.uint64))))
    head = gru.Head(hashes, *[np.ones(len(hashes), np.int64)] * 2, 0, 0, 0, 0, 0, 1.0, np.ones(1), 1)
    h = np.concatenate((hashes, hashes + np.uint64(1), rng.integers(0, 1 << 64, 5000, dtype=np.uint64), np.array([0, (1 << 64) - 1], np.uint64)))
    assert (head.find(h) == np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)).all()
