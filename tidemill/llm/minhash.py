"""Near-duplicates by b-bit MinHash with links confirmed on full sets.

1. A pass over the texts gives each document its set size, a digest of its set, BANDS hashes of ROWS minima each, and
   the low BITS bits of all minima, packed into longs. Equal sets form a class, and one document stands for it.
2. Documents that share a band hash are candidates. Within a band's bucket each member is compared with three members
   only (stars around the smallest, the greatest and a random one), if they meet in OFTEN buckets. The packed bits estimate the similarity, corrected
   for chance collisions; what may reach the threshold is confirmed on the full sets.
3. Components of the links. A bucket whose members are all in one component needs nothing more. For the others a longer
   signature is made (one bit of each of FINE minima), and members outside the bucket's largest component are compared with the members of
   other components by it, in the first bucket that two documents share; what passes is confirmed. This finds every link
   that the stars left open. No bucket is dropped or cut, and none of them is gathered in one task.
4. Components again give each document the smallest id that can be reached.

A pair at the threshold 0.8 shares no bucket with probability (1 - 0.8**5)**32, three in a million.

NULL texts and texts without words have an empty set and are linked with nothing. Texts with fewer words than a shingle
are one shingle. Where ids are NULL or repeated, rows stand for themselves; the component's id is then the smallest id
in it. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemill.llm.common import distinct_ids, drop, fresh, frugal, ship, sieve, sifted, stored, within
from tidemill.llm.components import components, joined_components
from tidemill.llm.shingles import mix, shingle_sets

BANDS, ROWS, BITS = 32, 5, 2
#: The longer signature keeps one bit of each minimum: for as many bits in all it is the more exact one.
HASHES, FINE, FINE_BITS = BANDS * ROWS, 4096, 1
#: How far the estimates may fall short of the threshold before a pair is dropped: five and four and a half standard deviations.
MARGIN, FINE_MARGIN = 0.2, 0.0422
#: Stars compare two documents only if they meet as member and centre this often; the rest is left to the third step.
OFTEN = 3
_rng = np.random.Generator(np.random.PCG64(11))
_MUL = (_rng.integers(0, 1 << 31, FINE, dtype=np.uint64) * 2 + 1).astype(np.uint32)[:, None]
_ADD = _rng.integers(0, 1 << 32, FINE, dtype=np.uint64).astype(np.uint32)[:, None]


def signature(shingles: np.ndarray, hashes: int = HASHES) -> np.ndarray:
    """Minima (32 bits) of a set that isn't empty; long sets are walked in slices."""
    x = (shingles >> np.uint64(32)).astype(np.uint32) ^ shingles.astype(np.uint32)
    out, width = None, max(64, (1 << 19) // hashes)
    for at in range(0, len(x), width):
        m = (x[None, at : at + width] * _MUL[:hashes] + _ADD[:hashes]).min(axis=1)
        out = m if out is None else np.minimum(out, m)
    return out


def band_hashes(minima: np.ndarray) -> np.ndarray:
    rows = minima.reshape(BANDS, ROWS).astype(np.uint64)
    h = np.arange(1, BANDS + 1, dtype=np.uint64)
    for j in range(ROWS):
        h = mix(h * np.uint64(0x9E3779B97F4A7C15) + rows[:, j])
    return h.view(np.int64)


def packed_bits(minima: np.ndarray, bits: int = BITS) -> np.ndarray:
    """The low bits of each minimum, 64 / bits to a long."""
    low = (minima & np.uint32((1 << bits) - 1)).astype(np.uint64).reshape(-1, 64 // bits)
    return (low << (np.arange(64 // bits, dtype=np.uint64) * np.uint64(bits))).sum(axis=1, dtype=np.uint64).view(np.int64)


def _features(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 400):
                part = b.slice(at, 400)
                n, digests, bits, bands = [], [], [], []
                for s in shingle_sets(part.column(1).to_pylist(), k):
                    n.append(len(s))
                    digests.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                    if len(s):
                        m = signature(s)
                        bits.append(packed_bits(m))
                        bands.append(band_hashes(m))
                    else:
                        bits.append(None)
                        bands.append(None)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(n, pa.int64()), pa.array(digests, pa.binary()), pa.array(bits, pa.list_(pa.int64())), pa.array(bands, pa.list_(pa.int64()))],
                    names=["key", "n", "digest", "bits", "bands"],
                )

    return run


def _fine(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 400):
                part = b.slice(at, 400)
                bits = [packed_bits(signature(s, FINE), FINE_BITS) if len(s) else None for s in shingle_sets(part.column(1).to_pylist(), k)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(bits, pa.list_(pa.int64()))], names=["key", "bits"])

    return run


def _sets(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 400):
                part = b.slice(at, 400)
                sets = [s.view(np.int64) for s in shingle_sets(part.column(1).to_pylist(), k)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sets, pa.list_(pa.int64()))], names=["key", "shingles"])

    return run


def estimate(a: Column, b: Column, hashes: int = HASHES, bits: int = BITS) -> Column:
    """Similarity from two packed signatures: equal places less those that agree by chance."""
    odd = F.lit(sum(1 << (bits * i) for i in range(64 // bits)) - (1 << 64 if bits == 1 else 0)).cast("long")
    wrong = []
    for i in range(hashes * bits // 64):
        x = F.get(a, F.lit(i)).bitwiseXOR(F.get(b, F.lit(i)))
        any_bit = reduce(lambda u, v: u.bitwiseOR(v), [F.shiftrightunsigned(x, j) for j in range(bits)]) if bits > 1 else x
        wrong.append(F.bit_count(any_bit.bitwiseAND(odd)))
    equal = F.lit(1.0) - reduce(lambda u, v: u + v, wrong) / F.lit(float(hashes))
    chance = 2.0**-bits
    return (equal - chance) / (1 - chance)


def _confirmed(pairs: DataFrame, docs: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs (a, b) with 100 * intersection >= percent * union of their full sets."""
    need = stored(pairs.select(F.col("a").alias("key")).unionByName(pairs.select(F.col("b").alias("key"))).distinct(), "to_confirm")
    sets = stored(sifted(docs.select("key", "text"), "key", sieve(need, "key")).mapInArrow(frugal(_sets(k)), "key long, shingles array<long>"), "sets")
    left = pairs.join(sets.withColumnsRenamed({"key": "a", "shingles": "sa"}).hint("merge"), "a")
    both = left.join(sets.withColumnsRenamed({"key": "b", "shingles": "sb"}).hint("merge"), "b")
    common = F.size(F.array_intersect("sa", "sb"))
    links = stored(both.filter(100 * common >= percent * (F.size("sa") + F.size("sb") - common)).select("a", "b"), "links")
    drop(need, sets)
    return links


def near_duplicates(docs: DataFrame, k: int, threshold: float = 0.8) -> DataFrame:
    """(key, n, component) for docs(key long, text), whose keys are distinct: set size, smallest key that can be reached."""
    spark = docs.sparkSession
    ship(spark)
    percent = round(100 * threshold)
    feats = stored(docs.select("key", "text").mapInArrow(frugal(_features(k)), "key long, n long, digest binary, bits array<long>, bands array<long>"), "signatures")
    some = feats.filter("n > 0")
    classes = stored(some.groupBy("digest").agg(F.min("key").alias("rep")), "classes")
    reps = feats.join(classes.select(F.col("rep").alias("key")).hint("merge"), "key", "left_semi")
    rows = reps.select(F.col("key").alias("id"), F.posexplode("bands").alias("nth", "band"))
    hubs = rows.groupBy("band").agg(F.min("id").alias("h0"), F.max("id").alias("h1"), F.min_by("id", F.xxhash64("id")).alias("h2")).filter("h0 <> h1")
    hubs = stored(hubs, "hubs")
    members = stored(sifted(rows, "band", sieve(hubs, "band")).join(hubs, "band"), "members")
    bits = stored(reps.select("key", "bits"), "bits")
    ends = members.select(F.col("id").alias("x"), F.explode(F.array("h0", "h1", "h2")).alias("y")).filter("x <> y")
    pairs = ends.groupBy(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).agg(F.count(F.lit(1)).alias("c")).filter(F.col("c") >= OFTEN).select("a", "b")
    judged = pairs.join(bits.withColumnsRenamed({"key": "a", "bits": "x"}), "a").join(bits.withColumnsRenamed({"key": "b", "bits": "y"}), "b")
    stars = stored(judged.filter(estimate(F.col("x"), F.col("y")) >= threshold - MARGIN).select("a", "b"), "stars")
    found = stored(components(_confirmed(stars, docs, k, percent)), "components")

    named = stored(members.join(found, "id", "left").select("band", "nth", "id", F.coalesce("component", "id").alias("label")), "named")
    open_bands = stored(named.groupBy("band").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo <> hi").select("band"), "open_bands")
    if not within(open_bands, 0):
        rest = stored(sifted(named, "band", sieve(open_bands, "band")).join(open_bands, "band", "left_semi"), "open_members")
        sizes = rest.groupBy("band", "label").agg(F.count(F.lit(1)).alias("c"))
        major = stored(sizes.groupBy("band").agg(F.max_by("label", F.struct("c", "label")).alias("major")), "major")
        need = stored(rest.select(F.col("id").alias("key")).distinct(), "open_ids")
        fine = sifted(docs.select("key", "text"), "key", sieve(need, "key")).mapInArrow(frugal(_fine(k)), "key long, bits array<long>")
        narrow = F.transform("bands", lambda x: x.bitwiseAND(F.lit(0x7FFFFFFF).cast("long")).cast("int"))
        fine = stored(fine.join(sifted(reps, "key", sieve(need, "key")).select("key", narrow.alias("bands")), "key").select(F.col("key").alias("id"), "bits", "bands"), "fine")
        full = stored(rest.join(major, "band").join(fine.hint("merge"), "id"), "open_rows")
        one = full.filter("label <> major").select("band", F.col("id").alias("a"), F.col("label").alias("la"), F.col("bits").alias("x"), F.col("bands").alias("xb"))
        other = full.select("band", "nth", F.col("id").alias("b"), F.col("label").alias("lb"), F.col("bits").alias("y"), F.col("bands").alias("yb"), (F.col("label") == F.col("major")).alias("big"))
        apart = (F.col("la") != F.col("lb")) & (F.col("big") | (F.col("a") < F.col("b"))) & (estimate(F.col("x"), F.col("y"), FINE, FINE_BITS) >= threshold - FINE_MARGIN)
        first = F.array_position(F.zip_with("xb", "yb", lambda u, v: u == v), True) == F.col("nth") + 1
        more = one.join(other.hint("merge"), (one["band"] == other["band"]) & apart & first).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
        more = stored(more, "more_pairs")
        drop(full, fine)
        if not within(more, 0):
            found = stored(joined_components(found, _confirmed(more, docs, k, percent)), "components")
    named = classes.join(found.withColumnRenamed("id", "rep"), "rep", "left").select("digest", F.coalesce("component", "rep").alias("component"))
    named = stored(named, "class_components")
    whole = feats.select("key", "n", F.when(F.col("n") > 0, F.col("digest")).alias("digest")).join(named, "digest", "left")
    return whole.select("key", "n", F.coalesce("component", "key").alias("component"))


def keyed(docs: DataFrame, key: str) -> tuple[DataFrame, bool]:
    """docs with a distinct long column ``key``, and whether that is doc_id; otherwise rows are numbered and stored."""
    if distinct_ids(docs):
        return docs.withColumn(key, F.col("doc_id").cast("long")), True
    return stored(docs.withColumn(key, F.monotonically_increasing_id()), "numbered"), False


def report(docs: DataFrame, k: int = 5, threshold: float = 0.8) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row of docs(doc_id, text)."""
    rows, own = keyed(docs.select("doc_id", "text"), "key")
    got = near_duplicates(rows.select("key", F.col("text").cast("string").alias("text")), k, threshold)
    if own:
        out = got.select(F.col("key").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"))
    else:
        got = stored(got.join(rows.select("key", "doc_id"), "key"), "numbered_components")
        least = stored(got.groupBy("component").agg(F.min("doc_id").alias("component_id")), "component_ids")
        out = got.join(least, "component").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def deduplicate(docs: DataFrame, k: int = 5, threshold: float = 0.8) -> DataFrame:
    """docs without all but one row of each component, in all its columns."""
    (key,) = fresh(docs, "__key")
    rows, _ = keyed(docs, key)
    got = near_duplicates(rows.select(F.col(key).alias("key"), F.col("text").cast("string").alias("text")), k, threshold)
    gone = stored(got.filter("key <> component").select(F.col("key").alias(key)), "gone")
    bitmap = sieve(gone, key)
    return sifted(rows, key, bitmap, hit=False).unionByName(sifted(rows, key, bitmap).join(gone, key, "left_anti")).drop(key)
