"""Language identification: multinomial naive Bayes over hashed character n-grams.

Training counts the n-grams of every training text by language (a partition adds up its own counts and sends only
buckets that occur), the counts of one language and bucket meet in a shuffle, and the log-probability matrix, of a
fixed number of buckets for each language, goes to the executors. Scoring walks whole texts in blocks: a look-up and a
segmented sum for each language.

The number of buckets doesn't depend on the number of languages. A matrix of BLOCK languages at most, 64 MB, is broadcast
at a time; with more languages there is a pass over the texts for each block, and a document carries its best language
and the sum of its likelihoods from pass to pass, which gives what one matrix would. The driver holds the list of
languages and one block.

Only the text is an input of a prediction. NULL texts and texts without a letter get ``und`` and score 0; so does
everything if no row has a language to learn. Equal scores go to the first language by code point. Equal texts get equal
results. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemill.llm import ngrams
from tidemill.llm.common import frugal, ship, stored

BITS = 14
SMOOTHING = 0.5
#: Languages of one broadcast matrix: 64 MB of 4-byte values.
BLOCK = (64 << 20) // (4 << BITS)
UNKNOWN = "und"


def _chunks(batches: Iterator[pa.RecordBatch], rows: int = 500) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def _count_task(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for b in _chunks(batches):
            by: dict[str, list[str]] = {}
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                by.setdefault(lang, []).append(text.lower())
            for lang, texts in by.items():
                into = total.setdefault(lang, np.zeros(1 << bits, np.int64))
                into += ngrams.counts("  ".join(texts), bits)
        for lang, c in total.items():
            at = np.flatnonzero(c)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(c[at], pa.int64())], names=["lang", "bucket", "n"])

    return run


@dataclass
class Model:
    """Languages in code-point order, and the counts of their buckets: (lang, bucket, n), stored; None without languages."""

    langs: list[str]
    counts: DataFrame | None
    bits: int = BITS

    def block(self, langs: list[str]) -> np.ndarray:
        """Log-probabilities of some of the languages, a row each."""
        spark = self.counts.sparkSession
        wanted = F.broadcast(spark.createDataFrame([(x,) for x in langs], "lang string"))
        got = self.counts.join(wanted, "lang").toArrow()
        where = {x: i for i, x in enumerate(langs)}
        matrix = np.full((len(langs), 1 << self.bits), SMOOTHING)
        matrix[np.array([where[x] for x in got.column("lang").to_pylist()], np.int64), got.column("bucket").to_numpy()] += got.column("n").to_numpy()
        return np.log(matrix / matrix.sum(axis=1, keepdims=True)).astype(np.float32)


def train(rows: DataFrame, bits: int = BITS) -> Model:
    """The counts of rows(lang, text)."""
    ship(rows.sparkSession)
    known = rows.filter(F.col("lang").isNotNull() & F.col("text").isNotNull()).select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    langs = sorted(r["lang"] for r in known.select("lang").distinct().collect())
    if not langs:
        return Model([], None, bits)
    return Model(langs, stored(known.mapInArrow(frugal(_count_task(bits)), "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")), "counts"), bits)


def classify(langs: list[str], matrix: np.ndarray, texts: list[str], before: tuple[list[str], np.ndarray, np.ndarray]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """The likeliest language of each text, its log-likelihood, and the sum of all likelihoods over it; before: the same of earlier languages."""
    bits = int(matrix.shape[1]).bit_length() - 1
    score, _ = ngrams.sums([t.lower() for t in texts], matrix, bits)
    pred, most, total = before
    at, new = score.argmax(axis=1), score.max(axis=1)
    top = np.maximum(most, new)
    total = total * np.exp(most - top) + np.exp(score - top[:, None]).sum(axis=1)
    return [langs[a] if n > m else p for p, m, a, n in zip(pred, most, at, new, strict=True)], top, total


def _pass(langs: list[str], sent, last: bool):
    """One block of languages over rows (doc_id, held_out, text, ok, pred, most, total). The last one leaves the text out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _chunks(batches):
            texts, ok, pred = (b.column(i).to_pylist() for i in (2, 3, 4))
            most, total = (np.array(b.column(i).to_numpy(zero_copy_only=False)) for i in (5, 6))
            at = [i for i, x in enumerate(ok) if x]
            if at:
                got, most[at], total[at] = classify(langs, sent.value, [texts[i] for i in at], ([pred[i] for i in at], most[at], total[at]))
                for i, x in zip(at, got, strict=True):
                    pred[i] = x
            text = pa.nulls(b.num_rows, pa.string()) if last else b.column(2)
            yield pa.RecordBatch.from_arrays([*b.columns[:2], text, b.column(3), pa.array(pred, pa.string()), pa.array(most), pa.array(total)], names=b.schema.names)

    return frugal(run)


def predict(docs: DataFrame, model: Model, held_out: Column, block: int = BLOCK) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) for docs(doc_id, text): the posterior probability, with equal priors."""
    spark = docs.sparkSession
    ship(spark)
    letters = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), held_out.alias("held_out"), F.when(letters, F.col("text").cast("string")).alias("text"), letters.alias("ok"),
        F.lit(UNKNOWN).alias("pred"), F.lit(float("-inf")).alias("most"), F.lit(0.0).alias("total"),
    )
    schema = "doc_id long, held_out boolean, text string, ok boolean, pred string, most double, total double"
    for at in range(0, len(model.langs), block):
        if at:
            rows = stored(rows, "scored")  # so that one matrix is in use at a time
        langs = model.langs[at : at + block]
        rows = rows.mapInArrow(_pass(langs, spark.sparkContext.broadcast(model.block(langs)), at + block >= len(model.langs)), schema)
    return rows.select("doc_id", "held_out", F.col("pred").alias("lang_pred"), F.when(F.col("total") > 0, 1 / F.col("total")).otherwise(0.0).alias("score"))
