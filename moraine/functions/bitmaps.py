"""Compressed bitmaps over small integers, in chunks of 65,536 as sorted arrays or bit fields."""

from __future__ import annotations

import numpy as np

CHUNK = 1 << 16
#: Up to this many members a chunk is a sorted array of 16-bit values, beyond it a bit field.
SPARSE = 4096


class Bitmap:
    """An immutable set of integers below ``n``."""

    __slots__ = ("n", "chunks")

    def __init__(self, n: int, chunks: dict[int, np.ndarray]):
        self.n, self.chunks = n, chunks

    @classmethod
    def empty(cls, n: int) -> Bitmap:
        return cls(n, {})

    @classmethod
    def of(cls, values: np.ndarray, n: int) -> Bitmap:
        values = np.unique(values)
        parts = np.split(values, np.flatnonzero(np.diff(values // CHUNK)) + 1) if len(values) else []
        return cls(n, {int(p[0] // CHUNK): _pack(p % CHUNK) for p in parts})

    def __or__(self, other: Bitmap) -> Bitmap:
        chunks = dict(self.chunks)
        for k, c in other.chunks.items():
            chunks[k] = _shrink(_bits(chunks[k]) | _bits(c)) if k in chunks else c
        return Bitmap(self.n, chunks)

    def and_not(self, other: Bitmap) -> Bitmap:
        chunks = {}
        for k, c in self.chunks.items():
            if k not in other.chunks:
                chunks[k] = c
                continue
            o = other.chunks[k]
            if c.dtype == np.uint16:
                kept = c[~_has(o, c)]
                if len(kept):
                    chunks[k] = kept
            else:
                left = _bits(c) & ~_bits(o)
                if left.any():
                    chunks[k] = _shrink(left)
        return Bitmap(self.n, chunks)

    def decode(self) -> np.ndarray:
        parts = [_members(c).astype(np.int64) + k * CHUNK for k, c in sorted(self.chunks.items())]
        return np.concatenate(parts) if parts else np.empty(0, np.int64)

    def __len__(self) -> int:
        return sum(len(c) if c.dtype == np.uint16 else int(np.unpackbits(c).sum()) for c in self.chunks.values())


def _pack(low: np.ndarray) -> np.ndarray:
    if len(low) <= SPARSE:
        return low.astype(np.uint16)
    flags = np.zeros(CHUNK, np.uint8)
    flags[low] = 1
    return np.packbits(flags)


def _bits(c: np.ndarray) -> np.ndarray:
    if c.dtype == np.uint8:
        return c
    flags = np.zeros(CHUNK, np.uint8)
    flags[c] = 1
    return np.packbits(flags)


def _members(c: np.ndarray) -> np.ndarray:
    return c if c.dtype == np.uint16 else np.flatnonzero(np.unpackbits(c))


def _shrink(bits: np.ndarray) -> np.ndarray:
    members = np.flatnonzero(np.unpackbits(bits))
    return members.astype(np.uint16) if len(members) <= SPARSE else bits


def _has(c: np.ndarray, values: np.ndarray) -> np.ndarray:
    if c.dtype == np.uint8:
        return (c[values >> 3] >> (7 - (values & 7)).astype(np.uint8)) & 1 == 1
    at = np.minimum(np.searchsorted(c, values), len(c) - 1)
    return c[at] == values
