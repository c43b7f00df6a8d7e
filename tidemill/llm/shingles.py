"""Word shingles of whole texts as 64-bit hashes, by the batch, in numpy.

Words are hashed without a Python loop: each byte times a random number for its place in the word, summed by word, and
mixed. Words longer than the table of random numbers are hashed one by one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import xxhash

PLACES, BLOCK = 512, 1 << 17
_R = np.random.Generator(np.random.PCG64(7)).integers(1, 1 << 63, PLACES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_S32, _S29 = np.uint64(32), np.uint64(29)
SINGLE = np.uint64(0x5851F42D4C957F2D)


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _S32)) * _A
    h = (h ^ (h >> _S29)) * _B
    return h ^ (h >> _S32)


def word_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of the texts, A-Z in lower case, and where each text's words begin (one more at the end).

    Texts are taken together up to BLOCK bytes, so that the arrays by byte stay in the processor's cache.
    """
    raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    hashes, firsts, begin, size, words = [], [np.zeros(1, np.int64)], 0, 0, 0
    for i, r in enumerate(raw):
        size += len(r) + 1
        if size >= BLOCK or i == len(raw) - 1:
            h, f = _block(raw[begin : i + 1])
            hashes.append(h)
            firsts.append(f[1:] + words)
            begin, size, words = i + 1, 0, words + len(h)
    return np.concatenate(hashes) if hashes else np.zeros(0, np.uint64), np.concatenate(firsts)


def _block(raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.fromiter((len(r) + 1 for r in raw), np.int64, len(raw))
    b = np.frombuffer(b"\n".join(raw).lower() + b"\n", np.uint8)
    ws = (b == 32) | (b - np.uint8(9) < 5)
    edges = np.flatnonzero(np.concatenate(([not ws[0]], ws[1:] != ws[:-1])))  # a word's start and its end in turn
    starts, ends = edges[::2], edges[1::2]
    firsts = np.searchsorted(starts, np.concatenate(([0], np.cumsum(sizes))))
    if not len(starts):
        return np.zeros(0, np.uint64), firsts
    lengths = ends - starts
    before = (np.cumsum(lengths) - lengths).astype(np.int32 if len(b) < 1 << 31 else np.int64)
    v = b[~ws].astype(np.uint64)
    place = np.arange(len(v), dtype=before.dtype) - np.repeat(before, lengths)
    long = np.flatnonzero(lengths > PLACES)
    if len(long):
        place = np.minimum(place, PLACES - 1)
    v += np.uint64(1)
    v *= _R[place]
    h = mix(np.add.reduceat(v, before) ^ lengths.astype(np.uint64))
    for i in long:
        h[i] = xxhash.xxh3_64_intdigest(b[starts[i] : ends[i]].tobytes())
    return h, firsts


def shingle_sets(texts: list[str | None], k: int) -> Iterator[np.ndarray]:
    """The sorted distinct k-word shingles of each text; with fewer words the whole sequence as one; none without words."""
    h, firsts = word_hashes(texts)
    n = len(h)
    if n >= k:
        s = h[: n - k + 1].copy()
        for j in range(1, k):
            s = mix(s * _A + h[j : n - k + 1 + j])
    for a, z in zip(firsts[:-1], firsts[1:], strict=True):
        if z - a >= k:
            yield np.unique(s[a : z - k + 1])
        elif z > a:
            one = np.array([SINGLE], np.uint64) + np.uint64(z - a)
            for i in range(a, z):
                one = mix(one * _A + h[i])
            yield one
        else:
            yield np.zeros(0, np.uint64)
