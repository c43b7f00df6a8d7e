"""Hashed character n-grams of whole texts, by the batch, in numpy.

A batch is cut into blocks of about BLOCK characters. Documents in a block are laid end to end with a space on each
side, so that no n-gram spans two of them and word edges count. A text longer than a block is walked in slices that
overlap by ORDER - 1 characters: every n-gram of the text is counted once, in bounded memory.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

BLOCK = 1_000_000
ORDERS = (2, 3)
_MUL = np.uint32(0x9E3779B1)


def hashes(codes: np.ndarray, order: int, bits: int) -> np.ndarray:
    """A bucket for the n-gram that starts at each place but the last order - 1."""
    h = codes[: len(codes) - order + 1] * np.uint32(0x85EBCA6B) + np.uint32(order)
    for k in range(1, order):
        h = (h ^ (h >> np.uint32(15))) * _MUL + codes[k : len(codes) - order + 1 + k]
    h ^= h >> np.uint32(16)
    h *= np.uint32(0xC2B2AE35)
    return h >> np.uint32(32 - bits)


def _codes(texts: list[str]) -> np.ndarray:
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4")


def blocks(texts: list[str], block: int = BLOCK, orders: tuple[int, ...] = ORDERS) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(document numbers, starts, codes) by block; a long document has several blocks, whose sums add up."""
    pending: list[str] = []
    ids: list[int] = []
    size, overlap = 0, max(orders) - 1

    def flush():
        starts = np.cumsum([0] + [len(t) for t in pending[:-1]], dtype=np.int64)
        return np.array(ids), starts, _codes(pending)

    for i, t in enumerate(texts):
        t = f" {t} "
        if len(t) > block:
            for at in range(0, len(t) - overlap, block):
                yield np.array([i]), np.zeros(1, np.int64), _codes([t[at : at + block + overlap]])
            continue
        pending.append(t)
        ids.append(i)
        size += len(t)
        if size >= block:
            yield flush()
            pending, ids, size = [], [], 0
    if pending:
        yield flush()


def sums(texts: list[str], tables: np.ndarray, bits: int, orders: tuple[int, ...] = ORDERS, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray]:
    """For each text and each table (rows of ``tables``) the sum of the table's values over its n-grams; and their number."""
    out, count = np.zeros((len(texts), len(tables))), np.zeros(len(texts), np.int64)
    for ids, starts, codes in blocks(texts, block, orders):
        sizes = np.diff(np.append(starts, len(codes)))
        long = len(ids) == 1 and sizes[0] > block  # a slice of a long text: its last overlap belongs to the next slice
        for n in orders:
            h = hashes(codes, n, bits)
            if len(h) == 0:
                continue
            # n-grams that start in the last n - 1 characters of a document span two documents: they count for nothing
            valid = np.ones(len(h), bool)
            ends = starts + sizes
            for k in range(1, n):
                at = ends[:-1] - k
                valid[at[(at >= 0) & (at < len(h))]] = False
            if long:
                valid[block:] = False
            at = np.minimum(starts, len(h) - 1)
            for j, table in enumerate(tables):
                v = table[h]
                v[~valid] = 0
                out[ids, j] += np.add.reduceat(v, at, dtype=np.float64)
            count[ids] += np.add.reduceat(valid, at, dtype=np.int64)
    return out, count


def counts(text: str, bits: int, orders: tuple[int, ...] = ORDERS, block: int = BLOCK) -> np.ndarray:
    """How often each bucket occurs in one text."""
    out = np.zeros(1 << bits, np.int64)
    for _, starts, codes in blocks([text], block, orders):
        for n in orders:
            h = hashes(codes, n, bits)
            if len(codes) > block:
                h = h[:block]
            out += np.bincount(h, minlength=1 << bits)
    return out
