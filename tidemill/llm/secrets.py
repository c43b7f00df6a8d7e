"""Secret scans over an incremental blob ledger, in DataFrame operations only.

Every version of a text is addressed by the SHA-256 of its content. A ledger keeps, for each blob, the rule versions
that have been run over it and what they found. A scan takes the blobs of the given versions, keeps those for which
some current rule version is not in the ledger, runs only the missing rules over one copy of each, appends a row to the
ledger, and joins the findings back to all paths. Scanning the same corpus again reads no text twice.

Spans come from the pieces between the matches: the lengths of pieces and matches add up to the places, in code points.

Plan: narrow (path, blob) rows; one shuffle of texts by blob, after each task has dropped its own copies, so that a blob
with a third of all rows moves once a task; a join of findings by blob whose hot side Spark may split.

NULL text counts as empty. Ids may be NULL or repeated: each row gets its findings. An empty table gives no rows and an
empty ledger. Texts are scanned whole. A ledger that holds a blob and rule twice, after a retry or two scans at once, gives
each span once. Columns other than doc_id and text are not read.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.llm.common import shared_folder, stored


@dataclass(frozen=True)
class Rule:
    """Matches of ``pattern`` whose ``group`` has at least ``least`` code points; matches that fail are dropped."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1
    version: int = 1

    @property
    def name(self) -> str:
        return f"{self.kind}@{self.version}"


ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: The first three are the base rules. Runs of a class are whole matches, so a least length can stand in the pattern.
RULES = (
    Rule("assign", ASSIGN, 2, 8),
    Rule("access", r"AKIA[A-Z0-9]{12,}"),
    Rule("hex", r"[0-9a-f]{32,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]+"),
    Rule("pem", r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----"),
    Rule("login", r"://[^\s/:@]{1,256}:[^\s/@]{1,256}@"),
)
BASE = ("assign", "access", "hex")
_LEDGER = "blob string, rules array<string>, found array<struct<rule:string,start:long,end:long>>"


def spans(text: Column, rule: Rule) -> Column:
    """array<struct<rule,start,end>> of one rule's matches in a text."""
    pattern = F.lit(rule.pattern)
    matches, groups = F.regexp_extract_all(text, pattern, F.lit(0)), F.regexp_extract_all(text, pattern, F.lit(rule.group))
    gaps = F.slice(F.split(text, rule.pattern, -1), F.lit(1), F.size(matches))
    kind = "array<struct<rule:string,start:long,end:long>>"
    none = F.array().cast(kind)

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["gap"])
        end = start + F.length(x["hit"])
        one = F.array(F.struct(F.lit(rule.name).alias("rule"), start.alias("start"), end.alias("end"))).cast(kind)
        return F.struct(end.cast("long").alias("at"), F.when(F.length(x["part"]) >= rule.least, F.concat(acc["out"], one)).otherwise(acc["out"]).alias("out"))

    zipped = F.arrays_zip(gaps.alias("gap"), matches.alias("hit"), groups.alias("part"))
    walked = F.aggregate(zipped, F.struct(F.lit(0).cast("long").alias("at"), none.alias("out")), step)
    return F.when(text.rlike(rule.pattern), walked["out"]).otherwise(none)


def blob_of(text: Column) -> Column:
    return F.sha2(F.coalesce(text.cast("string"), F.lit("")).cast("binary"), 256)


def read_ledger(spark: SparkSession, ledger: str) -> DataFrame:
    """The ledger's rows; none if nothing has been written there yet."""
    path = spark._jvm.org.apache.hadoop.fs.Path(ledger)
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], _LEDGER)
    return spark.read.schema(_LEDGER).parquet(ledger)


def scan(docs: DataFrame, ledger: str | None = None, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(doc_id, blob, found) for each row of docs(doc_id, text); found has the spans of all the given rules.

    ledger: a folder that lasts; by default one of this call's own, so that every blob is unseen.
    """
    spark = docs.sparkSession
    fresh = ledger is None
    ledger = ledger or f"{shared_folder(spark)}/tidemill/{uuid.uuid4().hex}/ledger"
    names = F.array(*[F.lit(r.name) for r in rules])
    versions = docs.select(F.col("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).withColumn("blob", blob_of(F.col("text")))
    texts = versions.select("blob", "text")
    if fresh:
        todo = texts.groupBy("blob").agg(F.any_value("text").alias("text")).withColumn("missing", names)
    else:
        seen = read_ledger(spark, ledger).select("blob", F.explode("rules").alias("rule")).groupBy("blob").agg(F.collect_set("rule").alias("seen"))
        blobs = texts.select("blob").distinct().join(seen, "blob", "left")
        missing = blobs.select("blob", F.array_except(names, F.coalesce("seen", F.array().cast("array<string>"))).alias("missing")).filter(F.size("missing") > 0)
        todo = texts.join(stored(missing, "unseen"), "blob").groupBy("blob").agg(F.any_value("text").alias("text"), F.any_value("missing").alias("missing"))
    found = F.concat(*[F.when(F.array_contains("missing", r.name), spans(F.col("text"), r)).otherwise(F.array().cast("array<struct<rule:string,start:long,end:long>>")) for r in rules])
    todo.select("blob", F.col("missing").alias("rules"), found.alias("found")).write.mode("append").parquet(ledger)
    known = read_ledger(spark, ledger).select("blob", F.filter("found", lambda x: F.array_contains(names, x["rule"])).alias("found"))
    if not fresh:
        known = known.groupBy("blob").agg(F.array_distinct(F.flatten(F.collect_list("found"))).alias("found"))
    paths = versions.select("doc_id", "blob")
    return paths.join(known, "blob", "left").select("doc_id", "blob", F.coalesce("found", F.array().cast("array<struct<rule:string,start:long,end:long>>")).alias("found"))


def joined(found: Column, kinds: tuple[str, ...]) -> Column:
    """kind:start:end of the given kinds by start and then by the order of ``kinds``, joined by commas."""
    place = F.array(*[F.lit(k) for k in kinds])
    own = F.transform(found, lambda x: F.struct(x["start"].alias("s"), F.array_position(place, F.split_part(x["rule"], F.lit("@"), F.lit(1))).alias("k"), x["end"].alias("e")))
    ordered = F.array_sort(F.filter(own, lambda x: x["k"] > 0))
    return F.array_join(F.transform(ordered, lambda x: F.concat_ws(":", F.element_at(place, x["k"].cast("int")), x["s"].cast("string"), x["e"].cast("string"))), ",")


def report(scanned: DataFrame) -> DataFrame:
    """Counts, digest and spans for each row of scan()."""
    count = lambda kind: F.size(F.filter("found", lambda x: F.startswith(x["rule"], F.lit(f"{kind}@")))).cast("long").alias(f"n_{kind}")
    base = joined(F.col("found"), BASE)
    everything = joined(F.col("found"), tuple(r.kind for r in RULES))
    return scanned.select("doc_id", *[count(k) for k in BASE], F.sha2(base.cast("binary"), 256).alias("base_sha256"), everything.alias("spans"))
