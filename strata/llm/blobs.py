"""Rows of packed arrays: what chunks of documents and buckets of hashes send each other.

An entry then takes a few bytes in a shuffle instead of a row's fifty, and numpy handles
a bucket's entries at once. The number of rows never exceeds the number of entries.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROWS = "bucket long, part int, seq int, blob binary"


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays in a compressed blob; whole numbers take as many bytes as they need."""
    import zstandard

    out = [len(arrays).to_bytes(4, "little")]
    for a in arrays:
        if a.dtype.kind in "iu" and a.dtype.itemsize > 1 and len(a) and a.min() >= 0:
            top = int(a.max())
            a = a.astype("u1" if top < 1 << 8 else "<u2" if top < 1 << 16 else "<u4" if top < 1 << 32 else "<u8")
        out += [a.dtype.str.encode().ljust(4), len(a).to_bytes(8, "little"), np.ascontiguousarray(a).tobytes()]
    return zstandard.ZstdCompressor(level=1).compress(b"".join(out))


def unpack(blob: bytes) -> list[np.ndarray]:
    import zstandard

    raw = zstandard.ZstdDecompressor().decompress(blob)
    at, out = 4, []
    for _ in range(int.from_bytes(raw[:4], "little")):
        kind, n = np.dtype(raw[at : at + 4].strip().decode()), int.from_bytes(raw[at + 4 : at + 12], "little")
        out.append(np.frombuffer(raw, kind, n, at + 12))
        at += 12 + n * kind.itemsize
    return out


def thin(hashes: np.ndarray) -> np.ndarray:
    """Sorted 64-bit hashes as bytes: differences, plane by plane, of which the high ones compress."""
    steps = np.diff(hashes.astype(np.uint64), prepend=np.uint64(0))
    return np.ascontiguousarray(steps.astype("<u8").view(np.uint8).reshape(-1, 8).T).ravel()


def thick(planes: np.ndarray) -> np.ndarray:
    """The hashes that ``thin`` packed."""
    steps = np.ascontiguousarray(planes.reshape(8, -1).T).view("<u8").ravel()
    return np.cumsum(steps, dtype=np.uint64)


def slot(hashes: np.ndarray, n: int) -> np.ndarray:
    """One of ``n`` slots by the high bits: sorted hashes have sorted slots."""
    return ((hashes >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int64)


def rows_of(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True))
    kinds = (pa.int64(), pa.int32(), pa.int32(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["bucket", "part", "seq", "blob"])


def by_group(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[tuple, list[tuple]]]:
    """Runs of rows whose first ``width`` columns are equal; input is sorted."""
    key, rows = None, []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if row[:width] != key:
                if rows:
                    yield key, rows
                key, rows = row[:width], []
            rows.append(row)
    if rows:
        yield key, rows


def dealt(rows: DataFrame, n: int, *keys: str) -> DataFrame:
    """``rows`` in ``n`` partitions, one for each value of the first key from 0 on, sorted by all keys."""
    return rows.repartitionById(n, F.col(keys[0]).cast("int")).sortWithinPartitions(*keys)


def chunks_of(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[list, list[bytes]]]:
    """(ids, texts) of runs of (id, text) rows with about ``most`` bytes each."""
    ids: list = []
    texts: list[bytes] = []
    size = 0
    for batch in batches:
        for i, t in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), strict=True):
            ids.append(i)
            texts.append(t)
            size += len(t)
            if size >= most:
                yield ids, texts
                ids, texts, size = [], [], 0
    if ids:
        yield ids, texts
