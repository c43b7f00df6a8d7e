"""Quality classifier by co-training of a text view and a metadata view.

The text view is a logistic regression over the frequencies of hashed character n-grams of the whole text, drawn towards
the mean in short texts, and the shares of words that repeat the one or two words before; the metadata view is one over
source, language and size. Both start from labelled documents. In each round each view scores all other documents and
labels some of those it is sure of, by its calibrated probability, for the other one. In the end the views are
calibrated on labelled documents that neither has learned from, and their log-odds are combined.

The labelled sample is bounded: PER_CLASS documents of each class, chosen by a hash of their id. The pool is every other
row, whole, in one pass a round. Of all that a view is sure of, a hash picks PER_ROUND of each class in the first round,
twice as many in the second, and so on; rows with equal scores, as copies have, count as one there, so that a group of
copies can't fill a round. Only ids of the sample and of what was picked are broadcast, a fixed number of them, and only
their features go to the driver, compressed, 8 KB a document there at most. It unpacks of a document what the view needs
that learns from it, and fits in place, so that it holds two such matrices at once. The last scoring is one pass without
a shuffle.

A document is kept if its probability of being good is at least KEEP. NULL texts count as empty, and NULL metadata is a
value of its own. Of labelled rows with the same id the smallest text is learned from; each row is scored by itself.
Repeated labels of an id count by majority, NULL ones not at all. Without labels of both classes nothing can be learned:
every document scores 1 and is kept. An empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.llm import ngrams
from tidemill.llm.common import drop, fresh, frugal, release, ship, stored
from tidemill.llm.shingles import word_hashes

BITS = 11
PER_CLASS = 1200
ROUNDS, SURE, PER_ROUND = 3, 0.97, 300
KEEP = 0.5
META = 64 + 16 + 24
LAGS, BOOST = (1, 2), 8.0
#: n-grams of the mean text that are added to every text.
SHRINK = 100.0
#: Rare n-grams vary less than this in the sample; scaled by their own deviation they would outweigh all others elsewhere.
LEAST_STD = 3e-4
TEXT = (1 << BITS) + len(LAGS)


def meta_features(source: str | None, lang: str | None, n_chars: int | None) -> np.ndarray:
    x = np.zeros(META, np.float32)
    x[zlib.crc32(repr(source).encode("utf-8", "surrogatepass")) % 64] = 1
    x[64 + zlib.crc32(repr(lang).encode("utf-8", "surrogatepass")) % 16] = 1
    x[80 + (23 if n_chars is None else min(22, max(0, int(n_chars)).bit_length()))] = 1
    return x


@dataclass
class Linear:
    """Logistic regression on scaled features; ``weights`` and ``bias`` apply to raw ones. a, b: calibration of its log-odds."""

    weights: np.ndarray
    bias: float
    a: float = 1.0
    b: float = 0.0
    mean: np.ndarray | None = None  # of the n-gram frequencies in training, for short texts

    def logit(self, x: np.ndarray) -> np.ndarray:
        return self.a * (x @ self.weights + self.bias) + self.b


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def _slices(n: int, size: int = 256) -> Iterator[slice]:
    """So many rows or columns at a time: what is made of them in between stays small."""
    return (slice(at, at + size) for at in range(0, n, size))


def fit(x: np.ndarray, y: np.ndarray, weight: np.ndarray, l2: float = 1e-3, steps: int = 250) -> Linear:
    """Full-batch Adam on standardized features; the few repeat shares count BOOST times, as each stands for many n-grams.

    x is overwritten by the standardized features.
    """
    mean, std = x.mean(axis=0), np.concatenate([x[:, part].std(axis=0) for part in _slices(x.shape[1])])
    scale = np.where(std > 0, 1 / np.maximum(std, LEAST_STD), 0).astype(np.float32)
    if x.shape[1] == TEXT:
        scale[1 << BITS :] *= BOOST
    z = np.subtract(x, mean, out=x)
    z *= scale
    w, b = np.zeros(x.shape[1], np.float32), 0.0
    m, v = np.zeros(len(w) + 1), np.zeros(len(w) + 1)
    weight = weight / weight.sum()
    for t in range(1, steps + 1):
        d = (_sigmoid(z @ w + b) - y) * weight
        g = np.append(sum(d[part] @ z[part] for part in _slices(len(z))) + l2 * w, d.sum())
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        step = 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
        w, b = (w - step[:-1]).astype(np.float32), b - step[-1]
    weights = w * scale
    return Linear(weights, float(b - mean @ weights))


def calibrate(model: Linear, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> Linear:
    """Platt scaling with smoothed targets, by gradient steps on two parameters."""
    s = x @ model.weights + model.bias
    unit = float(np.median(np.abs(s))) or 1.0
    n1, n0 = y.sum(), (1 - y).sum()
    target = np.where(y > 0.5, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    a, b, weight, s = 1.0, 0.0, weight / weight.sum(), s / unit
    for _ in range(400):
        d = (_sigmoid(a * s + b) - target) * weight
        a, b = max(0.0, a - 2.0 * float(d @ s)), b - 2.0 * float(d.sum())
    return Linear(model.weights, model.bias, a / unit, b)


@dataclass
class Model:
    text: Linear
    meta: Linear
    prior: float  # log-odds of a good document

    def combine(self, text: np.ndarray, meta: np.ndarray) -> np.ndarray:
        """Probability from the views' log-odds, as if they were independent given the class."""
        return _sigmoid(text + meta - self.prior)


#: For each view the features of the documents that the other one labels, and those labels.
Given = dict[str, tuple[np.ndarray, np.ndarray]]


def co_train(text: np.ndarray, meta: np.ndarray, y: np.ndarray, share: np.ndarray, fold: np.ndarray, prior: float, draw: Callable[[Model, int], Given], fit_on: np.ndarray | None = None) -> Model:
    """y: 0/1 labels; share: weights that restore the classes' true shares; fold: rows for calibration; fit_on: the others by default.

    draw(model, n): up to n documents of each class that either view of the model is sure of.
    """
    fit_on = ~fold if fit_on is None else fit_on
    views = {"text": text, "meta": meta}
    given: Given = {v: (x[:0], y[:0]) for v, x in views.items()}
    for r in range(ROUNDS + 1):
        models = {}
        for v, x in views.items():
            more, values = given.pop(v)
            own = np.flatnonzero(fit_on)
            xs, ys = np.empty((len(own) + len(more), x.shape[1]), np.float32), np.concatenate((y[own], values))
            np.take(x, own, axis=0, out=xs[: len(own)], mode="clip")  # any other mode makes a copy first
            xs[len(own) :] = more
            del more
            ws = np.concatenate((share[own], np.where(values > 0.5, share[y > 0.5].mean(), share[y < 0.5].mean())))
            models[v] = fit(xs, ys, ws)
            del xs
            models[v] = calibrate(models[v], x[fold], y[fold], share[fold])
        model = Model(models["text"], models["meta"], prior)
        if r < ROUNDS:
            release()
            given = {**draw(model, PER_ROUND * (r + 1))}
    return model


def repeats(texts: list[str | None]) -> np.ndarray:
    """For each text the shares of words that equal the word one place and two places before."""
    h, firsts = word_hashes(texts)
    out = np.zeros((len(texts), len(LAGS)), np.float32)
    doc = np.repeat(np.arange(len(texts)), np.diff(firsts))
    for j, lag in enumerate(LAGS):
        same = (h[lag:] == h[:-lag]) & (doc[lag:] == doc[:-lag]) if len(h) > lag else np.zeros(0, bool)
        hits = np.bincount(doc[lag:][same], minlength=len(texts)) if len(h) > lag else np.zeros(len(texts))
        out[:, j] = hits / np.maximum(1, np.diff(firsts))
    return out


def _text_features(text: str | None) -> np.ndarray:
    c = ngrams.counts(text or "", BITS).astype(np.float32)
    return np.concatenate((c, repeats([text])[0]))


def _frequencies(x: np.ndarray, mean: np.ndarray) -> np.ndarray:
    """Counts to frequencies, with SHRINK n-grams of the mean text added; x itself, overwritten."""
    c = x[:, : 1 << BITS]
    n = c.sum(axis=1, keepdims=True) + SHRINK
    c += SHRINK * mean
    c /= n
    return x


def _featurize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        ids, texts, langs, sources, sizes = (c.to_pylist() for c in b.columns)
        x = [zlib.compress(np.concatenate((_text_features(t), meta_features(s, g, n))).astype(np.float32).tobytes(), 1) for t, g, s, n in zip(texts, langs, sources, sizes, strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(x, pa.binary())], names=["doc_id", "x"])


def _inputs(docs: DataFrame) -> DataFrame:
    have = set(docs.columns)
    one = lambda c, t: (F.col(c) if c in have else F.lit(None)).cast(t).alias(c)
    return docs.select(one("doc_id", "long"), one("text", "string"), one("lang", "string"), one("source", "string"), one("n_chars", "long"))


def _features(docs: DataFrame, ids: list[int]) -> dict[int, bytes]:
    """By id the features of rows whose doc_id is among ids, a bounded number of them, still compressed."""
    if not ids:
        return {}
    wanted = docs.sparkSession.createDataFrame([(int(i),) for i in ids], "doc_id long")
    one = docs.join(F.broadcast(wanted), "doc_id").groupBy("doc_id").agg(F.min(F.struct("text", "lang", "source", "n_chars")).alias("s"))
    got = one.select("doc_id", "s.*").mapInArrow(frugal(_featurize), "doc_id long, x binary").toArrow()
    return dict(zip(got.column("doc_id").to_pylist(), got.column("x").to_pylist(), strict=True))


def _unpacked(packed: dict[int, bytes], ids: list[int], view: str) -> np.ndarray:
    """What the view sees of the documents, a row for each of ids: counts and repeat shares, or metadata."""
    at = slice(TEXT) if view == "text" else slice(TEXT, None)
    out = np.empty((len(ids), TEXT if view == "text" else META), np.float32)
    for i, doc_id in enumerate(ids):
        out[i] = np.frombuffer(zlib.decompress(packed[doc_id]), np.float32)[at]
    return out


def picks(scored: DataFrame, n: int) -> DataFrame:
    """(view, label, doc_id): up to n documents of each view and class that it is sure of; equal scores count as one document."""
    rows = []
    for v in ("text", "meta"):
        for label, sure in ((1, F.col(f"{v}_score") >= SURE), (0, F.col(f"{v}_score") <= 1 - SURE)):
            one = scored.filter(sure).groupBy(F.round("text_score", 6), F.round("meta_score", 6)).agg(F.min("doc_id").alias("doc_id"))
            rows.append(one.orderBy(F.xxhash64("doc_id"), "doc_id").limit(n).select(F.lit(v).alias("view"), F.lit(label).alias("label"), "doc_id"))
    return reduce(DataFrame.unionAll, rows)


def _drawer(pool: DataFrame, mean: np.ndarray) -> Callable[[Model, int], Given]:
    """draw of ``co_train`` over a pool(doc_id, text, lang, source, n_chars) of any size."""

    def draw(model: Model, n: int) -> Given:
        model.text.mean = mean
        sure = F.greatest("text_score", "meta_score") >= SURE
        sure |= F.least("text_score", "meta_score") <= 1 - SURE
        scored = stored(score(pool, model).filter(sure).select("doc_id", "text_score", "meta_score"), "sure")
        got = picks(scored, n).collect()  # 4 n rows at most
        drop(scored)
        packed = _features(pool, sorted({r["doc_id"] for r in got}))
        out: Given = {}
        for v, other in (("text", "meta"), ("meta", "text")):
            label = {r["doc_id"]: r["label"] for r in got if r["view"] == other}
            x = _unpacked(packed, sorted(label), v)
            out[v] = (_frequencies(x, mean) if v == "text" else x, np.array([label[i] for i in sorted(label)], np.float64))
        return out

    return draw


def train(docs: DataFrame, labels: DataFrame) -> Model | None:
    """Fit on docs(doc_id, text, lang, source, n_chars) and labels(doc_id, quality)."""
    ship(docs.sparkSession)
    votes = labels.filter("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((F.avg("quality") >= 0.5).cast("int").alias("quality"))
    shares = {r["quality"]: r["n"] for r in votes.groupBy("quality").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(shares) < 2:
        return None
    order = F.xxhash64("doc_id")
    picked = [votes.filter(F.col("quality") == q).orderBy(order, "doc_id").limit(PER_CLASS) for q in (0, 1)]
    labelled = picked[0].unionByName(picked[1]).toArrow().to_pydict()
    y_of = dict(zip(labelled["doc_id"], labelled["quality"], strict=True))
    rows = _inputs(docs)
    packed = _features(rows, list(y_of))
    ids = sorted(packed)
    y = np.array([y_of[i] for i in ids], np.float64)
    if len(set(y.tolist())) < 2:
        return None
    total = sum(shares.values())
    share = np.where(y > 0.5, shares[1] / total / max(1, y.sum()), shares[0] / total / max(1, (1 - y).sum()))
    fold = np.array([zlib.crc32(str(i).encode()) % 4 == 0 for i in ids], bool)
    if len(set(y[fold].tolist())) < 2 or len(set(y[~fold].tolist())) < 2:
        fold = fit_on = np.ones(len(y), bool)  # too few labels to hold any back: all serve for both
    else:
        fit_on = ~fold
    text, meta = (_unpacked(packed, ids, v) for v in ("text", "meta"))
    del packed
    c = text[:, : 1 << BITS]
    mean = sum((c[part] / np.maximum(1, c[part].sum(axis=1, keepdims=True)) * share[part, None]).sum(axis=0) for part in _slices(len(c))).astype(np.float32)
    # a row's id here is a hash of all of it, so that rows with equal or NULL ids stay apart
    mine = docs.sparkSession.createDataFrame([(int(i),) for i in ids], "doc_id long")
    pool = rows.join(F.broadcast(mine), "doc_id", "left_anti").select(F.xxhash64(*rows.columns).alias("doc_id"), *rows.columns[1:])
    model = co_train(_frequencies(text, mean), meta, y, share, fold, float(np.log(shares[1] / shares[0])), _drawer(pool, mean), fit_on)
    model.text.mean = mean
    del text, meta, c
    release()
    return model


_SCORES = ("text_score", "meta_score", "score")


def score(docs: DataFrame, model: Model | None, carry: str = "") -> DataFrame:
    """doc_id and the probabilities of both views and of their combination, and whether it is kept, for each row of docs.

    carry: all columns of docs instead of doc_id, and only whether it is kept besides, in a column of this name.
    """
    spark = docs.sparkSession
    ship(spark)
    cols = docs.columns if carry else ["doc_id"]
    if model is None:
        new = [F.lit(True).alias(carry)] if carry else [*[F.lit(1.0).alias(c) for c in _SCORES], F.lit(True).alias("kept")]
        return docs.select(*[F.col(f"`{c}`") for c in cols], *new)
    sent = spark.sparkContext.broadcast(model)
    own = [F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(cols)]
    inputs = _inputs(docs).columns[1:]
    have = set(docs.columns)
    extra = [(F.col(c) if c in have else F.lit(None)).cast("long" if c == "n_chars" else "string").alias(c) for c in inputs if not (carry and c in have)]
    rows = docs.select(*own, *extra)
    place = [rows.columns.index(c if c in rows.columns else f"c{cols.index(c)}") for c in inputs]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Model = sent.value
        table = m.text.weights[None, : 1 << BITS].astype(np.float32)
        tail, centre = m.text.weights[1 << BITS :], float(m.text.weights[: 1 << BITS] @ m.text.mean)
        for b in batches:
            for at in range(0, b.num_rows, 500):
                part = b.slice(at, 500)
                texts, langs, sources, sizes = (part.column(i).to_pylist() for i in place)
                sums, n = ngrams.sums([t or "" for t in texts], table, BITS)
                text = m.text.a * ((sums[:, 0] + SHRINK * centre) / (n + SHRINK) + repeats(texts) @ tail + m.text.bias) + m.text.b
                meta = m.meta.logit(np.stack([meta_features(s, g, c) for s, g, c in zip(sources, langs, sizes, strict=True)])).astype(np.float64)
                p = m.combine(text, meta)
                values = [pa.array(p >= KEEP)] if carry else [pa.array(_sigmoid(text)), pa.array(_sigmoid(meta)), pa.array(p), pa.array(p >= KEEP)]
                yield pa.RecordBatch.from_arrays([*part.columns[: len(cols)], *values], names=[*[f"c{i}" for i in range(len(cols))], *(["c_kept"] if carry else [*_SCORES, "kept"])])

    schema = [f"c{i} {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(cols)]
    schema += ["c_kept boolean"] if carry else [*[f"{c} double" for c in _SCORES], "kept boolean"]
    return rows.mapInArrow(frugal(run), ", ".join(schema)).withColumnsRenamed({f"c{i}": c for i, c in enumerate(cols)} | {"c_kept": carry})


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs without the rows that the classifier rejects, in all its columns."""
    (kept,) = fresh(docs, "__kept")
    return score(docs, train(docs, labels), carry=kept).filter(F.col(kept)).drop(kept)
