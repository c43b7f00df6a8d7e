"""Shared plumbing: the cluster's shared folder, stored intermediate tables, and shipping of this package to executors."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
import zipfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A token: no ASCII white space. Java's and Python's patterns agree on it.
WORD = r"[^\x20\x09-\x0D]+"
_ASCII_UPPER, _ASCII_LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_own: dict[str, str] = {}
_scratch: set[str] = set()
#: Words of 64 bits of a sieve: 16 MB as rows, whatever it was made from.
SIEVE_BITS = 20


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session. Where that is unset, as in tests: a temporary folder, in local mode only."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = _own.setdefault(spark.sparkContext.applicationId, "") or f"file://{tempfile.mkdtemp(prefix='tidemill-')}"
        _own[spark.sparkContext.applicationId] = at
    return at.rstrip("/")


def delete(spark: SparkSession, path: str) -> None:
    """Remove a folder in any file system that Spark opens."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def _tidy(spark: SparkSession, path: str) -> None:
    try:
        delete(spark, path)
    except Exception:  # noqa: BLE001  the session may have ended before the interpreter does
        pass


def scratch(spark: SparkSession) -> str:
    """This application's own part of the shared folder, deleted when the driver's interpreter ends."""
    path = f"{shared_folder(spark)}/tidemill/{spark.sparkContext.applicationId}"
    if path not in _scratch:
        _scratch.add(path)
        atexit.register(_tidy, spark, path)
    return path


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet to the shared folder and read again.

    It cuts the lineage: lost executors cost only the tasks that read this table, never its computation. Every call
    writes a folder of its own, so nothing stale is read; ``drop`` deletes it, and what is left goes at the end.
    """
    spark = df.sparkSession
    path = f"{scratch(spark)}/{uuid.uuid4().hex}/{name}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._tidemill_path = path
    return out


def drop(*tables: DataFrame) -> None:
    """Delete the folders of ``stored`` tables that no later plan reads."""
    for t in tables:
        _tidy(t.sparkSession, t._tidemill_path)


#: Rows and bytes of a batch, where the session has Spark's defaults: texts are long, and a task holds some batches at once.
BATCHES = {
    "spark.sql.execution.arrow.maxRecordsPerBatch": ("10000", "1000"),
    "spark.sql.execution.arrow.maxBytesPerBatch": ("67108864b", "4m"),
    "spark.sql.parquet.columnarReaderBatchSize": ("4096", "512"),
}


def frugal(task):
    """A task of mapInArrow that gives free memory back to the system when it ends: its worker stays for other tasks."""

    def run(batches):
        try:
            yield from task(batches)
        finally:
            release()

    return run


def release() -> None:
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def ship(spark: SparkSession) -> None:
    """Send this package to the executors' Python once a session, so that they need no copy of the repository; smaller batches."""
    for name, (default, ours) in BATCHES.items():
        if spark.conf.get(name, None) == default:
            spark.conf.set(name, ours)
    sc = spark.sparkContext
    if getattr(sc, "_tidemill_shipped", False):
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    path = os.path.join(tempfile.mkdtemp(prefix="tidemill-"), "tidemill_code.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(root):
            for n in sorted(names):
                if n.endswith(".py"):
                    full = os.path.join(folder, n)
                    z.write(full, os.path.relpath(full, os.path.dirname(root)))
    sc.addPyFile(path)
    sc._tidemill_shipped = True


def ascii_lower(c: Column) -> Column:
    """A-Z in lower case; other letters stay."""
    return F.translate(c, _ASCII_UPPER, _ASCII_LOWER)


def words(text: Column) -> Column:
    """The words of a text as an array, without empty ones; NULL has none."""
    parts = F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+")
    return F.filter(parts, lambda w: w != "")


def n_words(text: Column) -> Column:
    """Number of words. Each word with the white space after it becomes one letter, so that no array of words is made."""
    inner = F.btrim(F.coalesce(text, F.lit("")), F.lit(" \t\n\x0b\x0c\r"))
    return F.length(F.regexp_replace(inner, WORD + r"[\x20\x09-\x0D]*", "w")).cast("long")


def fold(doc_id: Column, n: int) -> Column:
    """crc32 of the id's decimal text, modulo n. A NULL id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % n


def within(df: DataFrame, most: int) -> bool:
    """Whether df has at most this many rows. It stops reading beyond that."""
    return df.limit(most + 1).count() <= most


def fresh(docs: DataFrame, *names: str) -> list[str]:
    """Column names like ``names`` that docs doesn't have, in any case of letters."""
    have, out = {c.lower() for c in docs.columns}, []
    for n in names:
        while n.lower() in have:
            n = f"_{n}"
        have.add(n.lower())
        out.append(n)
    return out


def distinct_ids(docs: DataFrame) -> bool:
    """Whether doc_id identifies the rows: none is NULL or repeated."""
    ids = docs.groupBy(F.col("doc_id").cast("long").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    return within(ids.filter("n > 1 or id is null"), 0)


def _place(key: Column) -> tuple[Column, Column]:
    h = F.xxhash64(key, F.lit(23))
    return F.shiftrightunsigned(h, 64 - SIEVE_BITS).cast("int"), h.bitwiseAND(F.lit(63).cast("long")).cast("int")


def sieve(keys: DataFrame, key: str) -> DataFrame:
    """A bitmap of the keys as rows (word, bits): 2**SIEVE_BITS rows at most, so that it can always be broadcast."""
    word, bit = _place(F.col(key))
    return stored(keys.groupBy(word.alias("word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), bit)).alias("bits")), "sieve")


def sifted(df: DataFrame, key: str, bitmap: DataFrame, hit: bool = True) -> DataFrame:
    """The rows of df whose key may be in the sieve (all that are, and some more), or those whose key is surely not.

    It only makes less to shuffle: whatever follows has to look at the keys themselves.
    """
    word, bit = _place(F.col(f"`{key}`"))
    w, b = fresh(df, "__word", "__bits")
    side = F.broadcast(bitmap.select(F.col("word").alias(w), F.col("bits").alias(b)))
    found = F.call_function("shiftrightunsigned", F.col(b), bit).bitwiseAND(F.lit(1).cast("long")) == 1
    cols = [F.col(f"`{c}`") for c in df.columns]
    if hit:
        return df.join(side, F.col(w) == word).filter(found).select(*cols)
    return df.join(side, F.col(w) == word, "left").filter(F.col(b).isNull() | ~found).select(*cols)
