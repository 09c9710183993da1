"""Columns of numbers as bytes, for rows that carry many values between tasks, and portions of texts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
import zstandard

#: Bytes of text that a task looks at together.
PORTION = 8 << 20


def spread(x: np.ndarray) -> np.ndarray:
    """Mix the bits of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def groups(*keys: np.ndarray) -> np.ndarray:
    """Where a new group begins in sorted keys."""
    new = np.zeros(len(keys[0]), bool)
    new[:1] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return new


def slices(bucket: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(bucket, from, to) of the buckets that occur in a sorted array."""
    starts = np.flatnonzero(groups(bucket)).tolist()
    yield from zip(bucket[starts].tolist(), starts, [*starts[1:], len(bucket)][: len(starts)], strict=True)


def range_bucket(h: np.ndarray, buckets: int) -> np.ndarray:
    """Equal ranges of the upper 32 bits, so that sorted hashes have sorted buckets."""
    return ((h >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def ascending(h: np.ndarray) -> bytes:
    """The upper 48 bits of sorted hashes: their differences, by planes of one byte (the upper ones are nearly all 0)."""
    steps = np.diff(h >> np.uint64(16), prepend=np.uint64(0))
    return np.ascontiguousarray(steps.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].T).tobytes()


def from_ascending(raw: bytes) -> np.ndarray:
    steps = np.zeros((len(raw) // 6, 8), np.uint8)
    steps[:, :6] = np.frombuffer(raw, np.uint8).reshape(6, -1).T
    return steps.view("<u8").reshape(-1).astype(np.uint64).cumsum(dtype=np.uint64) << np.uint64(16)


def numbers(x: np.ndarray) -> bytes:
    """Numbers below 2^32, by planes of one byte (the upper ones are nearly all 0)."""
    return x.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def from_numbers(raw: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(4, -1).T).view("<u4").reshape(-1).astype(np.int64)


def pack(blobs: list[bytes]) -> list[bytes]:
    compress = zstandard.ZstdCompressor(level=1).compress
    return [compress(x) for x in blobs]


def unpack(blobs: list[bytes]) -> list[bytes]:
    decompress = zstandard.ZstdDecompressor().decompress
    return [decompress(x) for x in blobs]


def portions(batches: Iterator[pa.RecordBatch], column: int = 1) -> Iterator[pa.RecordBatch]:
    """The batches in portions of about ``PORTION`` bytes of the texts in ``column``."""
    for batch in batches:
        sizes = np.cumsum(np.array(pa.compute.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False), np.int64)) // PORTION
        cuts = [0, *(np.flatnonzero(np.diff(sizes)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:], strict=False):
            if a < b:
                yield batch.slice(a, b - a)
                pa.default_memory_pool().release_unused()
        del batch  # before the next one comes
