"""Vectorised text kernels on the UTF-8 bytes of an Arrow batch.

A batch of texts is cut into blocks of about ``BLOCK_BYTES`` (one longer text
makes its own block), so the memory of a task is bounded by one block whatever
the size of the batch. All hashes are 64-bit and equal on every executor.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK_BYTES = 2 << 20
U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser (splitmix64)."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def seeded(x: np.ndarray, seed: int) -> np.ndarray:
    """One of a family of hash functions of already hashed values."""
    return mix(x + U64((seed * _BASE + 0x632BE59BD9B4E019) & (2**64 - 1)))


_VALUE = mix(np.arange(1, 257, dtype=U64) * U64(_BASE))
_VALUE_LOWER = _VALUE.copy()
_VALUE_LOWER[65:91] = _VALUE[97:123]

NOT_SPACE = np.ones(256, dtype=bool)
NOT_SPACE[[32, 9, 10, 11, 12, 13]] = False
ALNUM = np.zeros(256, dtype=bool)
ALNUM[48:58] = ALNUM[65:91] = ALNUM[97:123] = ALNUM[128:] = True

_POWERS = np.ones(1, dtype=U64)
_INVERSE = np.ones(1, dtype=U64)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _POWERS, _INVERSE
    if len(_POWERS) < n:
        size = max(n, BLOCK_BYTES + 1)
        base = np.full(size, U64(_BASE))
        base[0] = 1
        inverse = np.full(size, U64(pow(_BASE, -1, 2**64)))
        inverse[0] = 1
        _POWERS, _INVERSE = np.cumprod(base, dtype=U64), np.cumprod(inverse, dtype=U64)
    return _POWERS[:n], _INVERSE


def ragged(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Concatenated ``arange(s, s + c)`` for each start and count."""
    total = int(counts.sum())
    if not total:
        return np.zeros(0, dtype=np.int64)
    before = np.cumsum(counts) - counts
    return np.repeat(starts - before, counts) + np.arange(total)


class Block:
    """Consecutive texts of a batch as one byte array with offsets."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, first: int):
        self.data, self.offsets, self.first = data, offsets, first
        self.n = len(offsets) - 1

    def text(self, i: int) -> str:
        return self.data[self.offsets[i]:self.offsets[i + 1]].tobytes().decode("utf-8", "replace")


def blocks(column: pa.Array | pa.ChunkedArray, size: int = BLOCK_BYTES) -> Iterator[Block]:
    """Blocks of a string column; null is the empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset:column.offset + len(column) + 1]
    if not len(column):
        return
    raw = column.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    lo = 0
    while lo < len(column):
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + size, "right")) - 1)
        yield Block(data[offsets[lo]:offsets[hi]], offsets[lo:hi + 1] - offsets[lo], lo)
        lo = hi


class Words:
    """Words of a block: byte ranges, 64-bit hashes and word offsets per text."""

    def __init__(self, block: Block, alphabet: np.ndarray, lower: bool, hashes: bool = True):
        data, n = block.data, len(block.data)
        inside = alphabet[data] if n else np.zeros(0, bool)
        edge = np.zeros(n + 1, dtype=bool)
        edge[block.offsets] = True
        before = np.zeros(n, dtype=bool)
        after = np.zeros(n, dtype=bool)
        if n:
            before[1:] = inside[:-1]
            after[:-1] = inside[1:]
            before[edge[:-1]] = False
            after[edge[1:]] = False
        self.starts = np.flatnonzero(inside & ~before)
        self.ends = np.flatnonzero(inside & ~after) + 1
        self.offsets = np.searchsorted(self.starts, block.offsets)
        self.counts = np.diff(self.offsets)
        self.block = block
        if hashes:
            self.hash = range_hash(block, self.starts, self.ends, lower)

    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(self.block.n), self.counts)


def range_hash(block: Block, starts: np.ndarray, ends: np.ndarray, lower: bool) -> np.ndarray:
    """Hash of each byte range: a polynomial over random byte values, so equal
    ranges are equal wherever they stand."""
    n = len(block.data)
    power, inverse = _powers(n + 1)
    total = np.zeros(n + 1, dtype=U64)
    np.cumsum((_VALUE_LOWER if lower else _VALUE)[block.data] * power[:n], out=total[1:], dtype=U64)
    h = (total[ends] - total[starts]) * inverse[starts]
    return mix(h + (ends - starts).astype(U64) * U64(0xD6E8FEB86659FD93))


def shingles(hashes: np.ndarray, offsets: np.ndarray, k: int, whole: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, first word, counts per text) of all k-word windows. ``whole``: a
    text of fewer words, but not none, is one window."""
    counts = np.diff(offsets)
    wins = np.maximum(counts - k + 1, 0)
    if whole:
        wins = np.where((counts > 0) & (counts < k), 1, wins)
    at = ragged(offsets[:-1], wins)
    length = np.minimum(np.repeat(counts, wins), k)
    out = length.astype(U64) * U64(0xA0761D6478BD642F)
    for j in range(k):
        if whole:
            live = length > j
            idx = np.where(live, at + j, 0)
            out = np.where(live, mix(out * U64(_BASE) + hashes[idx]) if len(at) else out, out)
        else:
            out = mix(out * U64(_BASE) + hashes[at + j])
    return out, at, wins


def distinct(values: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values of each group of a ragged array, with counts."""
    first = first_of(values, np.repeat(np.arange(len(counts)), counts))
    keep = np.flatnonzero(first)
    group = np.searchsorted(np.cumsum(counts), keep, "right")
    return values[keep], np.bincount(group, minlength=len(counts)).astype(np.int64)


def first_of(values: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Marks one occurrence of each distinct (group, value)."""
    key = seeded(values + group.astype(U64) * U64(0xD1B54A32D192ED03), 1)
    order = np.argsort(key)
    k = key[order]
    new = np.ones(len(k), dtype=bool)
    new[1:] = k[1:] != k[:-1]
    out = np.zeros(len(k), dtype=bool)
    out[order[new]] = True
    return out


def repeated(values: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Marks every value that stands twice or more in its group."""
    key = seeded(values + group.astype(U64) * U64(0xD1B54A32D192ED03), 1)
    order = np.argsort(key)
    k = key[order]
    same = k[1:] == k[:-1]
    out = np.zeros(len(k), dtype=bool)
    out[order[1:][same]] = True
    out[order[:-1][same]] = True
    return out


def group_sum(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sum of each group of a ragged array (wrapping for unsigned values)."""
    total = np.zeros(len(values) + 1, dtype=values.dtype)
    np.cumsum(values, out=total[1:], dtype=values.dtype)
    ends = np.cumsum(counts)
    return total[ends] - total[ends - counts]


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
