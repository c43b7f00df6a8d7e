"""TIFF round trips and damage; order MinHash against a plain computation."""

import hashlib
import random
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemill.llm import fingerprints, queries, tiff


@pytest.mark.parametrize("compression", [tiff.NONE, tiff.LZW, tiff.DEFLATE, tiff.PACKBITS])
@pytest.mark.parametrize("predictor", [1, 2])
@pytest.mark.parametrize("tile", [0, 16, 64])
def test_round_trip(compression, predictor, tile):
    rng = random.Random(compression)
    for n in (0, 1, 63, 64, 5000, 70_000):
        raw = tiff.payload_of("".join(rng.choice("aab é\n") for _ in range(n)) if n % 2 else "ab" * (n // 2))
        image = np.frombuffer(raw, np.uint8).reshape(-1, 64)
        half = len(image) // 2
        data = tiff.write([image[:half], image[half:]] if half else [image], compression, predictor, tile, rows_per_strip=100)
        assert b"".join(p.data.tobytes() for p in tiff.read(data)) == raw


def test_codecs_on_random_bytes():
    noise = np.random.default_rng(0).integers(0, 256, 40_000, dtype=np.uint8).tobytes()
    for data in (noise, bytes(5000), b"", b"a", b"ab" * 9000, noise[:300] + bytes(300)):
        assert tiff.lzw_decode(tiff.lzw_encode(data), len(data)) == data
        assert tiff.unpack_bits(tiff.pack_bits(data), len(data)) == data


def test_known_packbits_bytes():
    coded = bytes([0xFE, 0xAA, 0x02, 0x80, 0x00, 0x2A, 0xFD, 0xAA, 0x03, 0x80, 0x00, 0x2A, 0x22, 0xF7, 0xAA])
    plain = bytes([0xAA] * 3 + [0x80, 0x00, 0x2A] + [0xAA] * 4 + [0x80, 0x00, 0x2A, 0x22] + [0xAA] * 10)
    assert tiff.unpack_bits(coded, len(plain)) == plain


def big_endian_16bit():
    values = (np.arange(12).reshape(3, 4) * 1000).astype(">u2")
    data = zlib.compress(values.tobytes())
    out = bytearray(b"MM\0*" + struct.pack(">I", 8 + len(data))) + data
    tags = [(256, 4), (257, 3), (258, 16), (259, 8), (273, 8), (277, 1), (278, 3), (279, len(data))]
    out += struct.pack(">H", len(tags)) + b"".join(struct.pack(">HHI", t, 4, 1) + struct.pack(">I", v) for t, v in tags) + bytes(4)
    return bytes(out), values


def test_big_endian_16_bit():
    data, values = big_endian_16bit()
    (page,) = tiff.read(data)
    assert (page.data[:, :, 0] == values).all()


def test_pages_one_row_each_and_errors(spark):
    image = np.arange(64 * 3, dtype=np.uint8).reshape(3, 64)
    good = tiff.write([image, image[:1]])
    loop = bytearray(good)
    loop[-4:] = struct.pack("<I", struct.unpack_from("<I", good, 4)[0])
    rows = [(1, good), (2, None), (3, b"junk"), (4, bytes(loop)), (5, good[:40]), (6, big_endian_16bit()[0])]
    got = tiff.pages(spark.createDataFrame(rows, "k long, m binary"), "k", "m").orderBy("k", "page").collect()
    assert [(r["k"], r["page"], r["error"] is None) for r in got] == [(1, 0, True), (1, 1, True), (2, 0, False), (3, 0, False), (4, 0, True), (4, 1, True), (4, 2, False), (5, 0, False), (6, 0, True)]
    assert bytes(got[0]["data"]) == image.tobytes() and (got[0]["width"], got[0]["height"]) == (64, 3)


def test_digests(spark, docs, small_dir):
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    codecs = set()
    for r in queries.op9_tiff(spark, small_dir).collect():
        raw = (texts[r["doc_id"]] or "").encode()
        payload = raw + b"\0" * (-len(raw) % 64 or (0 if raw else 64))
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert r["media_sha256"] == hashlib.sha256(tiff.store(payload)).hexdigest() and r["media_bytes"] == len(tiff.store(payload))
        codecs.add(r["feature"].split(";")[2])
    assert len(codecs) == 4


def test_edited_texts(spark, docs, small_dir):
    rows = sorted(((r["doc_id"], r["text"] or "") for r in docs.collect()), reverse=True)
    got = {r["doc_id"]: r for r in queries.op10_order_minhash(spark, small_dir).collect()}
    assert len(got) == len(rows)
    better = 0
    for i, (d, t) in enumerate(rows):
        cut, nxt = len(t) // 3, rows[(i + 1) % len(rows)][1]
        edited = t[: len(t) - cut] + nxt[:cut]
        assert got[d]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest() and got[d]["n_chars"] == len(t)
        better += got[d]["near_edited"] > got[d]["near_next"]
    assert better > 0.9 * len(rows)


def test_fingerprint_places(spark):
    """Equal places are as many as the definition gives: the L smallest of each permutation, in text order."""
    rng = random.Random(6)
    texts = ["", "a", "a b", "a b a b a b a b", "Here " * 300, " ".join(rng.choice("abcdefg") for _ in range(400))]
    df = fingerprints.with_fingerprint(spark.createDataFrame([(t,) for t in texts], "text string"), "text", "fp")
    words = fingerprints.words(F.col("text"))
    hashes = df.select("text", "fp", F.transform(words, lambda w: F.xxhash64(w)).alias("h")).collect()
    mask, low = ~fingerprints._POS, fingerprints._POS

    def h64(*args):
        text = ", ".join(f"cast({a} as bigint)" if kind == "l" else f"cast({a} as int)" for kind, a in args)
        return f"xxhash64({text})"

    for r in hashes:
        h = r["h"]
        if len(h) < 2:
            continue
        kmers = list(spark.sql(f"select array({', '.join(h64(('l', a), ('l', b)) for a, b in zip(h, h[1:], strict=False))})").first()[0])
        seen, occ = {}, []
        for k in kmers:
            key = k >> fingerprints.POSITION_BITS
            occ.append(seen.get(key, 0))
            seen[key] = seen.get(key, 0) + 1
        values = spark.sql(f"select array({', '.join(h64(('l', k), ('i', o)) for k, o in zip(kmers, occ, strict=True))})").first()[0]
        packed = [(v & mask) | i for i, v in enumerate(values)]
        for m, seed in enumerate(fingerprints.seeds(fingerprints.M)):
            first = sorted(((p ^ seed), p & low) for p in packed)[: fingerprints.L]
            x = m
            for _, pos in sorted(first, key=lambda e: e[1]):
                x = spark.sql(f"select {h64(('l', x), ('l', kmers[pos]))}").first()[0] if m < 2 else x
            if m < 2:
                assert r["fp"][m] == x & 0x7FFFFFFF


def test_order_matters(spark):
    rng = random.Random(8)
    w = [str(rng.random()) for _ in range(300)]
    texts = [" ".join(w), " ".join(w[150:] + w[:150]), " ".join(w[:290])]
    fp = [r["fp"] for r in fingerprints.with_fingerprint(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string"), "text", "fp").orderBy("i").collect()]
    same = lambda a, b: sum(x == y for x, y in zip(a, b, strict=True)) / len(a)
    assert same(fp[0], fp[2]) > same(fp[0], fp[1])


def test_codecs_are_spread_evenly():
    got = [next(iter(tiff.read(tiff.store(tiff.payload_of(f"text {i}"))))).compression for i in range(400)]
    assert all(got.count(c) > 70 for c in (tiff.LZW, tiff.PACKBITS, tiff.NONE, tiff.DEFLATE))


def test_damaged_files_give_an_error_row(spark):
    """Random bytes of good files changed, in every layout: each file gives pages or an error row, and the job goes on."""
    rng = np.random.default_rng(5)
    rows = []
    for i in range(400):
        codec = (tiff.NONE, tiff.LZW, tiff.DEFLATE, tiff.PACKBITS)[i % 4]
        data = bytearray(tiff.write([rng.integers(0, 9, (40, 64)).astype(np.uint8)], codec, 1 + i // 4 % 2, 64 * (i % 3 == 0)))
        for at in rng.integers(0, len(data), 1 + i % 5) if i % 2 else len(data) - rng.integers(1, 140, 3):
            data[at] = int(rng.integers(0, 256))
        rows.append((i, bytes(data)))
    got = tiff.pages(spark.createDataFrame(rows, "id long, media binary"), "id", "media").collect()
    assert {r["id"] for r in got} == set(range(400)) and any(r["error"] for r in got) and any(not r["error"] for r in got)


def test_every_place_and_likeness_against_plain_code(spark):
    """Fingerprints of all places, and near_edited and near_next, from those that with_fingerprint gives alone."""
    texts = ["a b c d e f g h a b c", "one two three four five six", "x", "", "a b c d e f g h i j k l", "one two three four nine six"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    order = [5, 4, 3, 2, 1, 0]
    nxt = {d: order[(order.index(d) + 1) % 6] for d in order}
    edited = {d: texts[d][: len(texts[d]) - len(texts[d]) // 3] + texts[nxt[d]][: len(texts[d]) // 3] for d in order}
    alone = spark.createDataFrame([(t,) for t in {*texts, *edited.values()}], "t string")
    fp = {r["t"]: list(r["f"]) for r in fingerprints.with_fingerprint(alone, "t", "f").collect()}
    like = lambda a, b: sum(x == y for x, y in zip(fp[a], fp[b], strict=True)) / len(fp[a])
    for r in fingerprints.edits(docs).collect():
        d = r["doc_id"]
        assert r["fingerprint"] == "".join(f"{x:08x}" for x in fp[texts[d]]) and r["edited_fingerprint"] == "".join(f"{x:08x}" for x in fp[edited[d]])
        assert r["near_edited"] == like(texts[d], edited[d]) and r["near_next"] == like(texts[d], texts[nxt[d]])
