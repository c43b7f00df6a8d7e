"""The queries of this subpackage and their SQL, for __spark_entry__.py."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.llm.common import fold, ship
from tidemill.llm.oracle import SQL


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemill.llm.packing import pack

    return pack(_documents(spark, sf_dir))


def op2_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemill.llm.minhash import report

    return report(_documents(spark, sf_dir), k=2)


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemill.llm.mixing import copies

    got = copies(_documents(spark, sf_dir))
    return got.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies", "source")


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemill.llm.langid import predict, train

    docs = _documents(spark, sf_dir)
    held_out = fold(F.col("doc_id"), 5) == 0
    return predict(docs, train(docs.filter(~held_out).select("lang", "text")), held_out)


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, text_score, meta_score, score, kept."""
    from tidemill.llm.quality import score, train

    docs = _documents(spark, sf_dir)
    return score(docs, train(docs, spark.read.parquet(f"{sf_dir.rstrip('/')}/labels.parquet")))


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemill.llm.secrets import report, scan

    return report(scan(_documents(spark, sf_dir)))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_lines, n_dropped, and the text that is left (NULL where the document goes)."""
    from tidemill.llm.lines import deduplicate_lines

    return deduplicate_lines(_documents(spark, sf_dir), report=True)


def op7_line_dedup_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of op7_line_dedup, whose SQL has one edit, for three edits."""
    from tidemill.llm.lines import deduplicate_lines

    return deduplicate_lines(_documents(spark, sf_dir), edits=3, report=True)


def op8_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemill.llm.gru import score

    return score(_documents(spark, sf_dir), fold(F.col("doc_id"), 10) == 0)


def op9_tiff(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemill.llm.tiff import digests

    return digests(_documents(spark, sf_dir))


def op10_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemill.llm.fingerprints import edits

    return edits(_documents(spark, sf_dir))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_best_fit_packing, op2_minhash_dedup, op3_mixing, op4_language_id, op5_quality, op6_secret_scan, op7_line_dedup, op7_line_dedup_wide, op8_lm_score, op9_tiff, op10_order_minhash)
}

def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
