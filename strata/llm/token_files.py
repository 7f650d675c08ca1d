"""Token-id output: concatenated id arrays with Elias-Fano encoded document boundaries.

A segment holds the ids of consecutive documents as one array, and where each document
ends as an Elias-Fano code: the low bits of the ends packed, the high bits in unary, and
a sample of every 256th set bit, from which ``select`` finds any end without a table of
64-bit offsets. Segments lie in ascending order of document ids, as rows of a Parquet
table in the shared folder: a store that only Spark reaches is enough.

Layout of a segment, all little-endian (fixed values of the format): magic ``STRTOK01``;
unsigned 32-bit bytes per id, documents, low bits, words of high bits; unsigned 64-bit
ids; then low bits, high bits (64-bit words), samples (32-bit), ids.

Defined results. Null or empty text: the end id alone. Null ids sort first; documents
with equal ids follow by text, and each keeps its own place. A document longer than a
segment makes a segment of its own; it is read and encoded whole, so a task's memory is
in proportion to it. Other columns are left aside. An empty table gives no segments.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bound_batches, stash
from .tokens import encoder, groups_of, vocabulary_size

MAGIC = b"STRTOK01"
HEADER = struct.Struct("<8s4IQ")
SAMPLE = 256
#: A segment is closed once it holds this many ids.
SEGMENT_IDS = 1 << 20

SEGMENTS = "part int, segment int, before long, n_ids long, doc_ids array<long>, data binary"


def _pack_bits(values: np.ndarray, width: int) -> bytes:
    if not width:
        return b""
    bits = (values.astype(np.uint64)[:, None] >> np.arange(width, dtype=np.uint64)) & np.uint64(1)
    return np.packbits(bits.astype(np.uint8).ravel(), bitorder="little").tobytes()


@dataclass
class EliasFano:
    """The ends of ``n`` documents: a non-decreasing sequence, all below 2^63."""

    n: int
    low_width: int
    low: np.ndarray  # packed bits
    high: np.ndarray  # 64-bit words
    samples: np.ndarray

    @staticmethod
    def encode(ends: np.ndarray) -> EliasFano:
        n, last = len(ends), int(ends[-1]) if len(ends) else 0
        width = max(0, (last // n).bit_length() - 1) if n else 0
        places = (ends >> width) + np.arange(n)
        words = int((places[-1] if n else 0) // 64 + 1)
        bits = np.zeros(words * 64, np.uint8)
        bits[places] = 1
        low = np.frombuffer(_pack_bits(ends & ((1 << width) - 1), width), np.uint8)
        return EliasFano(n, width, low, np.packbits(bits, bitorder="little").view("<u8"), places[::SAMPLE].astype("<u4"))

    def low_of(self, i: int) -> int:
        if not self.low_width:
            return 0
        a = i * self.low_width
        cut = int.from_bytes(self.low[a // 8 : (a + self.low_width + 7) // 8].tobytes(), "little")
        return (cut >> (a % 8)) & ((1 << self.low_width) - 1)

    def select(self, i: int) -> int:
        """The end of document ``i``: from the nearest sample, count set bits onward."""
        at = int(self.samples[i // SAMPLE])
        left = i % SAMPLE
        word = at // 64
        cut = int(self.high[word]) >> (at % 64) << (at % 64)
        while left >= cut.bit_count():
            left -= cut.bit_count()
            word += 1
            cut = int(self.high[word])
        for _ in range(left):
            cut &= cut - 1
        place = word * 64 + (cut & -cut).bit_length() - 1
        return ((place - i) << self.low_width) | self.low_of(i)


def write_segment(ids: np.ndarray, ends: np.ndarray, width: int) -> bytes:
    code = EliasFano.encode(ends)
    head = HEADER.pack(MAGIC, width, code.n, code.low_width, len(code.high), len(ids))
    return b"".join([head, code.low.tobytes(), code.high.tobytes(), code.samples.tobytes(), ids.astype(f"<u{width}").tobytes()])


def read_segment(data: bytes) -> tuple[np.ndarray, EliasFano]:
    magic, width, n, low_width, words, n_ids = HEADER.unpack_from(data)
    if magic != MAGIC:
        raise ValueError("this is no segment of token ids")
    at = HEADER.size

    def take(kind: str, count: int) -> np.ndarray:
        nonlocal at
        got = np.frombuffer(data, kind, count, at)
        at += got.nbytes
        return got

    low, high, samples = take("u1", -(-n * low_width // 8)), take("<u8", words), take("<u4", -(-n // SAMPLE))
    return take(f"<u{width}", n_ids), EliasFano(n, low_width, low, high, samples)


def write_tokens(docs: DataFrame, definition: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", by_words: bool = False, segment_ids: int = SEGMENT_IDS) -> DataFrame:
    """Encode, append ``end_id`` to each document, write, and return the table of segments.

    Documents are dealt out by ranges of their ids, so tasks write consecutive parts;
    ``before`` counts the ids of the part's earlier segments.
    """
    bound_batches(docs.sparkSession)
    width = 2 if max(vocabulary_size(definition) - 1, end_id) < 1 << 16 else 4
    sent = docs.sparkSession.sparkContext.broadcast(definition)
    rows = docs.select(F.col(id_col).cast("long").alias("i"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    # A very common id is split where its texts begin differently, so it fills no task alone.
    rows = rows.repartitionByRange(F.asc_nulls_first("i"), F.substring("t", 1, 32)).sortWithinPartitions(F.asc_nulls_first("i"), "t")
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool, part = encoder(sent.value, by_words), TaskContext.get().partitionId()
        segment = before = 0
        names: list = []
        blobs: list[bytes] = []
        held = 0

        def close() -> pa.RecordBatch:
            nonlocal segment, before, held
            ids = np.frombuffer(b"".join(blobs), "<u4")
            data = write_segment(ids, np.cumsum([len(b) // 4 for b in blobs]), width)
            out = pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([segment], pa.int32()), pa.array([before]), pa.array([held]), pa.array([names], pa.list_(pa.int64())), pa.array([data], pa.binary())],
                names=["part", "segment", "before", "n_ids", "doc_ids", "data"],
            )
            segment, before, held = segment + 1, before + held, 0
            names.clear()
            blobs.clear()
            return out

        for batch in batches:
            own, texts = batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist()
            for a, b in groups_of(texts):
                for name, blob in zip(own[a:b], tool.packed(texts[a:b]), strict=True):
                    names.append(name)
                    blobs.append(blob + end)
                    held += len(blob) // 4 + 1
                    if held >= segment_ids:
                        yield close()
        if blobs:
            yield close()

    return stash(rows.mapInArrow(run, SEGMENTS), "tokens")


def read_tokens(segments: DataFrame) -> DataFrame:
    """Per document, from the files: doc_id, start, n_tokens, ids_crc32.

    The bases of the parts are broadcast: one row for each task that wrote.
    """
    bound_batches(segments.sparkSession)
    totals = segments.groupBy("part").agg(F.sum("n_ids").alias("n"))
    bases = totals.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("base"))
    placed = segments.join(F.broadcast(bases), "part").select("doc_ids", (F.col("base") + F.col("before")).alias("at"), "data")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for names, at, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                ids, code = read_segment(data)
                ends = np.array([code.select(i) for i in range(code.n)], np.int64)
                starts = np.concatenate([[0], ends[:-1]])
                plain = ids.astype("<u4")
                sums = [zlib.crc32(plain[a:b].tobytes()) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(names, pa.int64()), pa.array(starts + at, pa.int64()), pa.array(ends - starts, pa.int64()), pa.array(sums, pa.int64())],
                    names=["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    return placed.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")
