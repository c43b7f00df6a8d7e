"""Document fingerprints by order MinHash, in DataFrame operations only.

A k-mer is a run of K words. Equal k-mers of a text are numbered by occurrence, so that repetition counts. For each of
M permutations the L k-mers that come first under it are taken, put back into text order, and hashed as one tuple: two
texts agree in a place only if they share these k-mers in the same order, which follows their edit distance and not
only their sets. The likeness of two fingerprints is the share of equal places.

One hash of (k-mer, occurrence) carries all permutations: permutation i orders the hashes after an XOR of their top bits
with i. So after one sort the first L of a permutation are among the first L of each block of equal top bits, M * L
values, however long the text. The low POSITION_BITS of each value hold the place in the text instead of hash bits.
Occurrence numbers come from sorting (hash, place) and counting along each run of equal hashes by doubling, so a text
that repeats one word costs n log n.

Texts with fewer than K words are one k-mer (their words in order); texts without words are one k-mer too (the whole
text). NULL text counts as empty. Equal texts have equal fingerprints.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemill.llm.common import stored, within, words

K, L, M = 2, 2, 16
POSITION_BITS = 26
_POS = (1 << POSITION_BITS) - 1


def block_bits(m: int) -> int:
    return max(1, (m - 1).bit_length())


def seeds(m: int) -> list[int]:
    """What each permutation's hashes are XORed with: its number in the top bits, as a signed long."""
    shift = 64 - block_bits(m)
    return [(i << shift) - (1 << 64) if i >> (block_bits(m) - 1) else i << shift for i in range(m)]


def with_fingerprint(df: DataFrame, text: str, out: str, k: int = K, l: int = L, m: int = M) -> DataFrame:  # noqa: E741
    """df with column ``out``: array<int> of m places. Each step is a column of its own, so that none is computed twice."""
    keep = df.columns
    zero = F.lit(0).cast("long")
    df = df.withColumn("__w", words(F.col(text)))
    df = df.withColumn("__h", F.transform("__w", lambda w: F.xxhash64(w)))
    few = F.array(F.when(F.size("__h") == 0, F.xxhash64(F.coalesce(text, F.lit("")), F.lit(0))).otherwise(F.aggregate("__h", F.lit(1).cast("long"), lambda a, x: F.xxhash64(a, x))))
    kmers = F.col("__h")
    for j in range(1, k):
        n = F.size("__h") - j
        kmers = F.zip_with(F.slice(kmers, F.lit(1), n), F.slice("__h", F.lit(1 + j), n), lambda a, b: F.xxhash64(a, b))
    df = df.withColumn("__k", F.when(F.size("__h") < k, few).otherwise(kmers))
    high, low = F.lit(~_POS).cast("long"), F.lit(_POS).cast("long")
    packed = F.transform("__k", lambda h, i: F.coalesce(h.bitwiseAND(high).bitwiseOR(i.cast("long")), zero))
    df = df.withColumn("__s", F.sort_array(packed))
    same = lambda x, j: F.when((j > 0) & (F.shiftright(x, POSITION_BITS) == F.shiftright(F.get("__s", j - 1), POSITION_BITS)), 1).otherwise(0)
    df = df.withColumn("__d", F.transform("__s", same))

    def double(acc: Column, t: Column) -> Column:
        step = F.call_function("shiftleft", F.lit(1), t)
        return F.when(F.array_max(acc) >= step, F.transform(acc, lambda x, j: F.when(x < step, x).otherwise(x + F.get(acc, j - step)))).otherwise(acc)

    rounds = F.sequence(F.lit(0), F.ceil(F.log2(F.size("__d") + 1)).cast("int"))
    df = df.withColumn("__r", F.aggregate(rounds, F.col("__d"), double))
    place = lambda x: x.bitwiseAND(low)
    value = lambda x, r: F.xxhash64(F.get("__k", place(x).cast("int")), r).bitwiseAND(high).bitwiseOR(place(x))
    df = df.withColumn("__u", F.zip_with("__s", "__r", lambda x, r: F.coalesce(value(x, r), zero)))
    df = df.withColumn("__u", F.sort_array("__u"))
    block = lambda x: F.shiftrightunsigned(x, 64 - block_bits(m))
    df = df.withColumn("__f", F.filter("__u", lambda x, j: (j < l) | (block(x) != block(F.get("__u", j - l)))))

    def first(seed: int) -> Column:
        flip = F.lit(seed).cast("long")
        return F.slice(F.sort_array(F.transform("__f", lambda x: F.coalesce(x.bitwiseXOR(flip), zero))), 1, l)

    df = df.select(*keep, "__k", *[first(s).alias(f"__m{i}") for i, s in enumerate(seeds(m))])

    def tuple_hash(i: int) -> Column:
        inorder = F.array_sort(F.transform(f"__m{i}", lambda x: place(x).cast("int")))
        return F.aggregate(inorder, F.lit(i).cast("long"), lambda a, p: F.xxhash64(a, F.get("__k", p))).bitwiseAND(F.lit(0x7FFFFFFF).cast("long")).cast("int")

    return df.select(*keep, F.array(*[tuple_hash(i) for i in range(m)]).alias(out))


def likeness(a: Column, b: Column) -> Column:
    """Share of equal places of two fingerprints."""
    return F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda e: e)) / F.size(a)


def as_text(fp: Column) -> Column:
    return F.array_join(F.transform(fp, lambda x: F.lower(F.lpad(F.hex(x), 8, "0"))), "")


def successors(rows: DataFrame, key: str, order: list[Column], carry: list[str]) -> DataFrame:
    """rows with next_<c> for each c of ``carry``: the value in the next row by ``order``; after the last comes the first.

    Ranges of the order go to different tasks. The row after a range is the first row of the next range that has any;
    these first rows, one a task at most, are the only thing that is looked at as a whole.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = stored(rows.repartitionByRange(parts, *order).withColumn("__part", F.spark_partition_id()), "ranges")
    w = Window.partitionBy("__part").orderBy(*order)
    inside = ranged.withColumn("__next", F.lead(F.struct(*carry)).over(w)).withColumn("__rn", F.row_number().over(w))
    inside = stored(inside, "successors")
    firsts = inside.filter("__rn = 1").select("__part", F.struct(*carry).alias("__first"))
    every = Window.orderBy("__part")
    whole = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    after = firsts.select("__part", F.coalesce(F.lead("__first").over(every), F.first("__first").over(whole)).alias("__after"))
    joined = inside.join(F.broadcast(after), "__part", "left")
    nxt = F.coalesce("__next", "__after")
    return joined.select(*rows.columns, *[nxt[c].alias(f"next_{c}") for c in carry])


def edits(docs: DataFrame) -> DataFrame:
    """Fingerprints of each text of docs(doc_id, text), of its edited text, and their likeness.

    The edited text: the last third of the code points, rounded down, replaced by the first as many (or all) of the next
    document by descending id. Rows with equal ids follow each other by length and fingerprint; NULL ids come last.

    Texts are shuffled once by id and that exchange serves both sides; besides it moves at most a third of each text.
    """
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    ids = base.select("doc_id")
    if within(ids.filter("doc_id is null"), 0) and ids.count() == ids.distinct().count():
        base = base.withColumn("key", F.col("doc_id"))
    else:
        base = stored(base.withColumn("key", F.monotonically_increasing_id()), "keyed")
    own = with_fingerprint(base.withColumn("n_chars", F.length("text").cast("long")), "text", "fp").drop("text")
    own = stored(own, "fingerprints")
    chain = successors(own, "key", [F.desc_nulls_last("doc_id"), F.asc("n_chars"), F.asc("fp"), F.asc("key")], ["key", "fp"])
    chain = chain.withColumn("cut", F.floor(F.col("n_chars") / 3).cast("int")).withColumn("near_next", likeness(F.col("fp"), F.col("next_fp"))).drop("next_fp")
    texts = base.select("key", "text")
    heads = chain.join(texts.withColumnsRenamed({"key": "next_key", "text": "head"}), "next_key").withColumn("head", F.substring(F.col("head"), F.lit(1), F.col("cut"))).drop("next_key")
    both = heads.join(texts, "key")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), (F.col("n_chars") - F.col("cut")).cast("int")), F.col("head"))
    both = both.withColumn("edited", edited).drop("text", "head")
    both = with_fingerprint(both, "edited", "edited_fp")
    return both.select("doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), as_text(F.col("fp")).alias("fingerprint"), as_text(F.col("edited_fp")).alias("edited_fingerprint"), likeness(F.col("fp"), F.col("edited_fp")).alias("near_edited"), "near_next")
