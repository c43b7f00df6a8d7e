"""Best-fit packing: documents into as few sequences of at most ``capacity`` tokens as possible.

Method: bounded-space online best fit. A fixed number of bins is open; a bitset has one bit for each amount of free
space, so the tightest bin that still takes a piece is the lowest set bit at or above its length. When a new bin is
needed and the limit is reached, the fullest open bin closes.

Plan: a partition tokenizes and packs its own documents in one pass; only ids' checksums and places leave it, never
text. The pieces of the bins that are still open at its end go to the next level, where an eighth as many tasks pack
them again, down to one task. A task holds at most OPEN_BINS bins at any level, however many documents there are.

NULL or empty text: one piece with the end id alone. Texts of any length are cut only if longer than the capacity.
Repeated rows and equal or NULL ids are packed as rows of their own. An empty table gives no rows. Other columns are
not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.llm.common import frugal, ship, stored
from tidemill.llm.tokens import default_path, ids_of

CAPACITY = 4096
OPEN_BINS = 512
FAN_IN = 8

_PIECE = [("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())]
_PACKED = pa.schema([*_PIECE, ("sequence_id", pa.int64()), ("offset", pa.int64()), ("open", pa.bool_())])
_DDL = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long, open boolean"


class Packer:
    """Places items one by one; ``closed`` gets (bin, [(item, offset), ...]) of each bin that closes."""

    def __init__(self, capacity: int = CAPACITY, open_bins: int = OPEN_BINS) -> None:
        self.capacity, self.limit = capacity, max(1, open_bins)
        self.free = 0  # bit f: some open bin has f tokens free
        self.by_free: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.items: dict[int, list] = {}
        self.made = 0
        self.closed: list[tuple[int, list]] = []

    def _take(self, f: int) -> int:
        stack = self.by_free[f]
        b = stack.pop()
        if not stack:
            self.free ^= 1 << f
        return b

    def place(self, item, length: int) -> None:
        if not 0 < length <= self.capacity:
            raise ValueError(f"an item of {length} tokens doesn't fit into {self.capacity}")
        fits = self.free >> length
        if fits:
            f = length + (fits & -fits).bit_length() - 1
            b = self._take(f)
        else:
            if len(self.items) >= self.limit:
                fullest = self._take((self.free & -self.free).bit_length() - 1)
                self.closed.append((fullest, self.items.pop(fullest)))
            f, b = self.capacity, self.made
            self.made += 1
            self.items[b] = []
        self.items[b].append((item, self.capacity - f))
        left = f - length
        if left:
            self.by_free[left].append(b)
            self.free |= 1 << left
        else:
            self.closed.append((b, self.items.pop(b)))


def _pack_task(pieces: Iterator[list[tuple]], capacity: int, open_bins: int, level: int) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    base = (level << 56) | (TaskContext.get().partitionId() << 32)
    packer = Packer(capacity, open_bins)

    def out(bins, still_open: bool):
        rows = [(*item, base | b, at, still_open) for b, items in bins for item, at in items]
        if not rows:
            return
        cols = list(zip(*rows, strict=True))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, _PACKED.types, strict=True)], schema=_PACKED)

    for batch in pieces:
        for p in batch:
            packer.place(p, p[3])
        yield from out(packer.closed, False)
        packer.closed = []
    yield from out(packer.items.items(), True)


def _cut(doc_id, ids: bytes, capacity: int) -> list[tuple]:
    n, out = len(ids) // 4, []
    for k, start in enumerate(range(0, n, capacity)):
        part = ids[4 * start : 4 * (start + capacity)]
        out.append((doc_id, k, start, len(part) // 4, zlib.crc32(part)))
    return out


def pack(docs: DataFrame, capacity: int = CAPACITY, open_bins: int = OPEN_BINS, tokenizer: str | None = None) -> DataFrame:
    """Pieces of docs(doc_id, text) with their place: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    ship(docs.sparkSession)
    path = tokenizer or default_path()

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = ids_of(path)

        def pieces():
            for b in batches:
                for at in range(0, b.num_rows, 1000):
                    part = b.slice(at, 1000)
                    yield [p for d, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True) for p in _cut(d, ids(t), capacity)]

        return _pack_task(pieces(), capacity, open_bins, 0)

    level = 0
    packed = stored(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(frugal(first), _DDL), "packed0")
    done = [packed.filter(~F.col("open"))]
    tasks = packed.agg(F.max(F.shiftright(F.col("sequence_id"), 32).bitwiseAND(F.lit(0xFFFFFF))).alias("m")).first()["m"]
    tasks = 0 if tasks is None else tasks + 1
    rest = packed.filter("open")
    while tasks > 1:
        level, tasks = level + 1, -(-tasks // FAN_IN)

        def again(batches: Iterator[pa.RecordBatch], level: int = level) -> Iterator[pa.RecordBatch]:
            rows = (list(zip(*[c.to_pylist() for c in b.columns], strict=True)) for b in batches)
            return _pack_task(rows, capacity, open_bins, level)

        order = F.xxhash64("doc_id", "piece", "ids_crc32")
        items = rest.select("doc_id", "piece", "start", "length", "ids_crc32").repartition(tasks, order).sortWithinPartitions(order, "doc_id", "piece", "start", "ids_crc32")
        packed = stored(items.mapInArrow(frugal(again), _DDL), f"packed{level}")
        done.append(packed.filter(~F.col("open")))
        rest = packed.filter("open")
    out = rest
    for part in done:
        out = out.unionByName(part)
    return out.drop("open")
