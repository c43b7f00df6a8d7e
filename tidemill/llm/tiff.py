"""TIFF as a column: a reader for baseline images, and a writer of what it reads.

The reader walks the chain of image directories and decodes strips or tiles, uncompressed or in PackBits, LZW or
deflate, undoes the horizontal predictor, and gives one page for each directory. Little- and big-endian files are read.

``pages`` turns a column of files into one row a page. A NULL or damaged file gives one row with ``error`` set, so that
no file is lost without a trace and one bad file doesn't stop a job. A cyclic directory chain is an error, and a page's
claimed size is checked before its memory is taken.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.llm.common import frugal, ship

NONE, LZW, DEFLATE, OLD_DEFLATE, PACKBITS = 1, 5, 8, 32946, 32773
#: Largest page that is decoded, in bytes.
MOST = 1 << 30
WIDTH = 64
#: Rows of 64 samples on a page that the writer makes; longer payloads get more pages.
PAGE_ROWS = 4096
_SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8, 13: 4}
_CODES = {1: "B", 3: "H", 4: "I", 6: "b", 8: "h", 9: "i", 13: "I"}


class TiffError(ValueError):
    """The file can't be read."""


@dataclass
class Page:
    width: int
    height: int
    samples: int
    bits: int
    compression: int
    predictor: int
    tiled: bool
    data: np.ndarray  # height x width x samples


def unpack_bits(data: bytes, size: int) -> bytes:
    out, at, n = bytearray(), 0, len(data)
    while at < n and len(out) < size:
        c = data[at]
        if c < 128:
            out += data[at + 1 : at + 2 + c]
            at += 2 + c
        elif c > 128:
            out += data[at + 1 : at + 2] * (257 - c)
            at += 2
        else:
            at += 1
    return bytes(out)


def pack_bits(data: bytes) -> bytes:
    out, n = bytearray(), len(data)
    if not n:
        return b""
    a = np.frombuffer(data, np.uint8)
    edges = np.flatnonzero(np.diff(a)) + 1
    starts = np.concatenate(([0], edges))
    lengths = np.diff(np.append(starts, n))
    literal = 0  # where bytes not yet written begin

    def literals(to: int) -> None:
        for at in range(literal, to, 128):
            part = data[at : min(at + 128, to)]
            out.append(len(part) - 1)
            out.extend(part)

    for k in np.flatnonzero(lengths >= 3):
        s, ln = int(starts[k]), int(lengths[k])
        literals(s)
        end = s + ln
        while ln >= 2:
            run = min(ln, 128)
            out += bytes((257 - run, data[s]))
            ln -= run
        literal = end - ln
    literals(n)
    return bytes(out)


def lzw_decode(data: bytes, size: int) -> bytes:
    """Variable width codes, most significant bit first, 256 clears and 257 ends; the width grows one code early."""
    out, total, table = [], 0, [bytes((i,)) for i in range(256)] + [b"", b""]
    acc = bits = 0
    width, prev = 9, b""
    for byte in data:
        acc = (acc << 8) | byte
        bits += 8
        if bits < width:
            continue
        bits -= width
        code = acc >> bits
        acc &= (1 << bits) - 1
        if code == 256:
            del table[258:]
            width, prev = 9, b""
            continue
        if code == 257:
            break
        if code < len(table):
            entry = table[code]
        elif code == len(table) and prev:
            entry = prev + prev[:1]
        else:
            raise TiffError("LZW code out of range")
        out.append(entry)
        total += len(entry)
        if prev:
            table.append(prev + entry[:1])
            if len(table) in (511, 1023, 2047):
                width += 1
        prev = entry
        if total >= size:
            break
    return b"".join(out)


def lzw_encode(data: bytes) -> bytes:
    first = {bytes((i,)): i for i in range(256)}
    table, out = dict(first), bytearray()
    acc, bits, width, nxt = 256, 9, 9, 258
    cur = b""
    for i in range(len(data)):
        longer = cur + data[i : i + 1]
        if longer in table:
            cur = longer
            continue
        acc = (acc << width) | table[cur]
        bits += width
        table[longer] = nxt
        nxt += 1
        if nxt in (512, 1024, 2048):
            width += 1
        elif nxt == 4095:
            acc = (acc << width) | 256
            bits += width
            table, nxt, width = dict(first), 258, 9
        cur = data[i : i + 1]
        if bits >= 64:
            keep = bits & 7
            out += (acc >> keep).to_bytes(bits >> 3, "big")
            acc &= (1 << keep) - 1
            bits = keep
    if cur:
        acc = (acc << width) | table[cur]
        bits += width
        nxt += 1
        if nxt in (512, 1024, 2048):
            width += 1
    acc = (acc << width) | 257
    bits += width
    pad = -bits & 7
    out += (acc << pad).to_bytes((bits + pad) >> 3, "big")
    return bytes(out)


def _decode(data: bytes, compression: int, size: int) -> bytes:
    if compression == NONE:
        got = data
    elif compression == PACKBITS:
        got = unpack_bits(data, size)
    elif compression == LZW:
        got = lzw_decode(data, size)
    elif compression in (DEFLATE, OLD_DEFLATE):
        got = zlib.decompressobj().decompress(data, size)
    else:
        raise TiffError(f"compression {compression}")
    if len(got) < size:
        raise TiffError("a strip or tile is too short")
    return got[:size]


def _encode(data: bytes, compression: int) -> bytes:
    return {NONE: lambda d: d, PACKBITS: pack_bits, LZW: lzw_encode, DEFLATE: lambda d: zlib.compress(d, 1)}[compression](data)


def _tags(data: bytes, at: int, e: str) -> tuple[dict[int, tuple], int]:
    (n,) = struct.unpack_from(e + "H", data, at)
    tags = {}
    for k in range(n):
        tag, kind, count = struct.unpack_from(e + "HHI", data, at + 2 + 12 * k)
        size = _SIZES.get(kind, 0) * count
        where = at + 10 + 12 * k
        if size > 4:
            (where,) = struct.unpack_from(e + "I", data, where)
        if kind in _CODES:
            if where + size > len(data):
                raise TiffError("a tag lies outside the file")
            tags[tag] = struct.unpack_from(f"{e}{count}{_CODES[kind]}", data, where)
    (nxt,) = struct.unpack_from(e + "I", data, at + 2 + 12 * n)
    return tags, nxt


def _page(data: bytes, tags: dict[int, tuple], e: str) -> Page:
    one = lambda tag, default=None: tags.get(tag, (default,))[0]
    width, height, spp = one(256), one(257), one(277, 1)
    bits, comp, pred = one(258, 1), one(259, 1), one(317, 1)
    if not width or not height or bits not in (8, 16) or one(284, 1) != 1 or pred not in (1, 2) or len(set(tags.get(258, (bits,)))) != 1:
        raise TiffError("an image of this layout isn't read")
    unit = bits // 8
    if width * height * spp * unit > MOST:
        raise TiffError("the page is too large")
    dtype = np.dtype(np.uint8) if bits == 8 else np.dtype(("<" if e == "<" else ">") + "u2")
    tiled = 322 in tags
    tw, th = (one(322), one(323)) if tiled else (width, min(one(278, height), height))
    offsets, lengths = (tags.get(324, ()), tags.get(325, ())) if tiled else (tags.get(273, ()), tags.get(279, ()))
    across, down = -(-width // tw), -(-height // th)
    if len(offsets) != across * down or len(lengths) != len(offsets):
        raise TiffError("the number of strips or tiles is wrong")
    out = np.zeros((height, width, spp), dtype.newbyteorder("="))
    for k, (o, n) in enumerate(zip(offsets, lengths, strict=True)):
        y, x = k // across * th, k % across * tw
        rows = th if tiled else min(th, height - y)
        if o + n > len(data):
            raise TiffError("a strip or tile lies outside the file")
        block = np.frombuffer(_decode(data[o : o + n], comp, rows * tw * spp * unit), dtype).reshape(rows, tw, spp)
        if pred == 2:
            block = np.cumsum(block, axis=1, dtype=out.dtype)
        out[y : y + rows, x : x + tw] = block[: height - y, : width - x]
    return Page(width, height, spp, bits, comp, pred, tiled, out)


def read(data: bytes) -> Iterator[Page]:
    """The pages of a file, in the order of its directories."""
    if data is None or len(data) < 8 or data[:2] not in (b"II", b"MM"):
        raise TiffError("not a TIFF file")
    e = "<" if data[:2] == b"II" else ">"
    magic, at = struct.unpack_from(e + "HI", data, 2)
    if magic != 42:
        raise TiffError("not a TIFF file")
    seen = set()
    while at:
        if at in seen or at + 2 > len(data):
            raise TiffError("the chain of directories is broken")
        seen.add(at)
        try:
            tags, nxt = _tags(data, at, e)
            page = _page(data, tags, e)
        except TiffError:
            raise
        except (struct.error, zlib.error, ArithmeticError, LookupError, TypeError, ValueError) as x:
            raise TiffError(f"the file is damaged: {x}") from x
        yield page
        at = nxt


def write(pages: list[np.ndarray], compression: int = DEFLATE, predictor: int = 1, tile: int = 0, rows_per_strip: int = 1024) -> bytes:
    """8-bit single-channel pages (height x width) as a little-endian file; tile: side of square tiles, 0 for strips."""
    out = bytearray(b"II*\0\0\0\0\0")
    link = 4
    for page in pages:
        height, width = page.shape
        tw, th = (tile, tile) if tile else (width, min(rows_per_strip, height))
        offsets, lengths = [], []
        for y in range(0, height, th):
            for x in range(0, width, tw):
                block = page[y : y + th, x : x + tw]
                if tile and block.shape != (th, tw):
                    block = np.pad(block, ((0, th - block.shape[0]), (0, tw - block.shape[1])))
                if predictor == 2:
                    block = np.diff(block, axis=1, prepend=np.zeros((len(block), 1), np.uint8))
                coded = _encode(block.tobytes(), compression)
                offsets.append(len(out))
                lengths.append(len(coded))
                out += coded + b"\0" * (len(coded) & 1)
        place, count = (324, 325) if tile else (273, 279)
        tags = {256: [width], 257: [height], 258: [8], 259: [compression], 262: [1], 277: [1], 317: [predictor], place: offsets, count: lengths}
        tags |= {322: [tw], 323: [th]} if tile else {278: [th]}
        entries = []
        for tag in sorted(tags):
            v = tags[tag]
            if len(v) > 1:
                where = len(out)
                out += struct.pack(f"<{len(v)}I", *v)
                entries.append(struct.pack("<HHII", tag, 4, len(v), where))
            else:
                entries.append(struct.pack("<HHII", tag, 4, 1, v[0]))
        struct.pack_into("<I", out, link, len(out))
        out += struct.pack("<H", len(entries)) + b"".join(entries)
        link = len(out)
        out += b"\0\0\0\0"
    return bytes(out)


def payload_of(text: str | None) -> bytes:
    """UTF-8 and zero bytes up to a positive multiple of 64."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return raw + b"\0" * (-len(raw) % WIDTH if raw else WIDTH)


def store(payload: bytes) -> bytes:
    """The payload as 64 samples a row. The payload's checksum picks the layout, so that all the reader's ways are in use."""
    image = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    pick = zlib.crc32(payload)
    compression = (LZW, PACKBITS, NONE, DEFLATE)[pick % 4]
    return write([image[y : y + PAGE_ROWS] for y in range(0, len(image), PAGE_ROWS)], compression, 1 + (pick >> 4) % 2, 64 * ((pick >> 5) % 4 == 0))


def features(pages: list[Page]) -> str:
    """Pages, rows, layouts, mean and spread of the samples, and a histogram of their upper three bits."""
    flat = [p.data.ravel() for p in pages]
    n = sum(map(len, flat))
    hist = sum(np.bincount(x, minlength=256) for x in flat)
    at = np.arange(len(hist))
    mean = float((hist * at).sum() / n)
    var = max(0.0, float((hist * at * at).sum() / n) - mean * mean)
    coarse = hist[:256].reshape(8, 32).sum(axis=1)
    return f"pages={len(pages)};rows={sum(p.height for p in pages)};codec={pages[0].compression};predictor={pages[0].predictor};tiled={int(pages[0].tiled)};mean={mean:.4f};sd={var**0.5:.4f};hist={','.join(map(str, coarse))}"


_PAGES = "page int, width int, height int, samples int, bits int, compression int, predictor int, tiled boolean, data binary, error string"


def pages(df: DataFrame, key: str, media: str) -> DataFrame:
    """One row for each page of the files in column ``media``: the key, page, size, layout, and the samples as bytes."""
    ship(df.sparkSession)
    kind = df.schema[key].dataType.simpleString()
    types = (pa.int32(),) * 7 + (pa.bool_(), pa.binary(), pa.string())
    names = [key, *[x.split()[0] for x in _PAGES.split(", ")]]

    def row(k: pa.Array, values: tuple) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([k, *[pa.array([v], t) for v, t in zip(values, types, strict=True)]], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                k, data, n = b.column(0).slice(i, 1), b.column(1)[i].as_py(), 0
                try:
                    for p in read(data):
                        yield row(k, (n, p.width, p.height, p.samples, p.bits, p.compression, p.predictor, p.tiled, p.data.tobytes(), None))
                        n += 1
                    error = "" if n else "no pages"
                except TiffError as x:
                    error = str(x) or "damaged"
                if error:
                    yield row(k, (n, *[None] * 8, error))

    return df.select(key, media).mapInArrow(frugal(run), f"`{key}` {kind}, {_PAGES}")


_DIGEST = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, n_pages int, feature string"


def digests(docs: DataFrame) -> DataFrame:
    """Each text of docs(doc_id, text) stored as a TIFF file, read back page by page, and described.

    The file lives only within its row: a checksum of what was read, not of what was written, is returned. NULL text
    counts as empty, which is stored as 64 zero bytes. Equal texts give equal values; ids may be NULL or repeated. Very long
    texts get a page for each PAGE_ROWS rows. An empty table gives no rows; other columns are not read.
    """
    ship(docs.sparkSession)
    names = [x.split()[0] for x in _DIGEST.split(", ")]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.string()]

    def one(doc_id, text):
        raw = payload_of(text)
        media = store(raw)
        got = list(read(media))
        back = b"".join(p.data.tobytes() for p in got)
        n = len((text or "").encode("utf-8", "surrogatepass"))
        return (doc_id, n, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-64:]), len(media), hashlib.sha256(media).hexdigest(), len(got), features(got))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 500):
                part = b.slice(at, 500)
                rows = [one(d, t) for d, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(frugal(run), _DIGEST)
