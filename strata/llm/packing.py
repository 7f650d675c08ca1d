"""Best-fit packing with large-item matching, on the histogram of lengths.

Documents are tokenized and cut into pieces of at most ``capacity`` tokens. The plan
needs only how many pieces have each length, at most ``capacity`` numbers, so it is made
on the driver at any size of the corpus:

* pieces above a third of the capacity go at most two to a sequence: from the largest
  on, each is matched with the largest other such piece that still fits;
* smaller pieces, from the largest on, go where they leave the smallest gap; a new
  sequence is opened only when none has room.

Equal sequences are one class with a multiplicity. The plan lists, per length, which
ranks of its pieces go to which class; a piece's rank follows from counts per writing
task, so a very common length isn't gathered anywhere.

Defined results. Null or empty text: the end id alone, one piece. Only documents longer
than the capacity are cut; a very long one is encoded whole, so a task's memory is in
proportion to it. Null ids stay null. Repeated documents and ids are packed one by one.
Other columns are left aside. An empty table gives no rows.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bound_batches, stash
from .tokens import encoder, groups_of, vocabulary_size

CAPACITY = 4096
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, ids binary, part int, nth long"


def cut_pieces(docs: DataFrame, definition: str, end_id: int, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text", by_words: bool = False, with_ids: bool = True) -> DataFrame:
    """Pieces of tokenized documents, written; ``nth`` counts equal lengths within a task's ``part``.

    ``ids`` holds little-endian unsigned integers of 16 bits, or of 32 if the vocabulary needs
    them (null without ``with_ids``); ``ids_crc32`` is that of 32-bit integers.
    """
    bound_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(definition)
    rows = docs.select(F.col(id_col).cast("long").alias("i"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    end = np.array([end_id], "<u4").tobytes()
    narrow = max(vocabulary_size(definition) - 1, end_id) < 1 << 16

    def kept(own: bytes) -> bytes:
        return np.frombuffer(own, "<u4").astype("<u2").tobytes() if narrow else own

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool, part = encoder(sent.value, by_words), TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, np.int64)
        for batch in batches:
            names, texts = batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist()
            for a, b in groups_of(texts):
                out: list[tuple] = []
                for name, blob in zip(names[a:b], tool.packed(texts[a:b]), strict=True):
                    blob += end
                    for k, at in enumerate(range(0, len(blob), 4 * capacity)):
                        own = blob[at : at + 4 * capacity]
                        n = len(own) // 4
                        out.append((name, k, at // 4, n, zlib.crc32(own), kept(own) if with_ids else None, part, int(seen[n])))
                        seen[n] += 1
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)],
                    names=[f.split()[0] for f in PIECES.split(", ")],
                )

    return stash(rows.mapInArrow(run, PIECES), "pieces")


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, list[tuple[int, int]]]]:
    """Classes of equal sequences: (multiplicity, gap, [(length, how many), ...])."""
    left = {s: n for s, n in counts.items() if n}
    done: list[tuple[int, int, list[tuple[int, int]]]] = []
    open_: dict[int, list[tuple[int, list[tuple[int, int]]]]] = {}
    gaps: list[int] = []

    def put(gap: int, times: int, content: list[tuple[int, int]]) -> None:
        if gap not in open_:
            open_[gap] = []
            bisect.insort(gaps, gap)
        open_[gap].append((times, content))

    large = sorted(s for s in left if 3 * s > capacity)
    while large:
        s = large[-1]
        k = bisect.bisect_right(large, capacity - s) - 1
        if k >= 0 and large[k] == s and left[s] == 1:
            k -= 1
        if k < 0:
            put(capacity - s, left.pop(s), [(s, 1)])
            large.pop()
            continue
        p = large[k]
        if p == s:
            times, content = left[s] // 2, [(s, 2)]
            left[s] -= 2 * times
        else:
            times, content = min(left[s], left[p]), [(s, 1), (p, 1)]
            left[s] -= times
            left[p] -= times
        put(capacity - s - p, times, content)
        large = [x for x in large if left.get(x)] if not (left[s] and left[p]) else large
        left = {x: n for x, n in left.items() if n}
    for s in sorted(left, reverse=True):
        n = left[s]
        while n:
            at = bisect.bisect_left(gaps, s)
            if at == len(gaps):
                gap, times, content = capacity, -(-n // (capacity // s)), []
            else:
                gap = gaps[at]
                times, content = open_[gap].pop()
                if not open_[gap]:
                    del open_[gap]
                    gaps.pop(at)
            each = gap // s
            full = min(times, n // each)
            if full:
                put(gap - each * s, full, [*content, (s, each)])
                n, times = n - full * each, times - full
            if times and n:  # here n < each: the last ones of this length
                put(gap - n * s, 1, [*content, (s, n)])
                n, times = 0, times - 1
            if times and content:
                put(gap, times, content)
    for gap in gaps:
        done += [(times, gap, content) for times, content in open_[gap]]
    return done


def slots(classes: list[tuple[int, int, list[tuple[int, int]]]]) -> dict[int, np.ndarray]:
    """Per length, rows (first rank, first sequence, pieces a sequence, offset), by rank."""
    out: dict[int, list] = {}
    used: dict[int, int] = {}
    base = 0
    for times, _, content in classes:
        offset = 0
        for s, each in content:
            out.setdefault(s, []).append((used.get(s, 0), base, each, offset))
            used[s] = used.get(s, 0) + times * each
            offset += s * each
        base += times
    return {s: np.array(rows, np.int64) for s, rows in out.items()}


def place(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset``, without ``part`` and ``nth``.

    At most ``capacity`` rows come to the driver, and the slots that go back are bounded
    by the number of lengths, not of documents.
    """
    spark = pieces.sparkSession
    by_part = pieces.groupBy("part", "length").agg(F.count("*").alias("n"))
    counts = {r.length: r.n for r in by_part.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    sent = spark.sparkContext.broadcast(slots(plan(counts, capacity)))
    first = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = by_part.select("part", "length", F.coalesce(F.sum("n").over(first), F.lit(0)).alias("base"))
    ranked = pieces.join(bases, ["part", "length"]).select("doc_id", "piece", "start", "length", "ids_crc32", "ids", (F.col("base") + F.col("nth")).alias("rank"))
    names = [*ranked.columns[:-1], "sequence_id", "offset"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = sent.value
        for batch in batches:
            length, rank = batch.column(3).to_numpy(), batch.column(6).to_numpy()
            sequence, offset = np.empty(len(rank), np.int64), np.empty(len(rank), np.int64)
            order = np.argsort(length, kind="stable")
            for own in np.split(order, np.flatnonzero(np.diff(length[order])) + 1):
                if not len(own):
                    continue
                s = int(length[own[0]])
                rows = table[s]
                row = rows[np.searchsorted(rows[:, 0], rank[own], side="right") - 1]
                nth = rank[own] - row[:, 0]
                sequence[own] = row[:, 1] + nth // row[:, 2]
                offset[own] = row[:, 3] + nth % row[:, 2] * s
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(sequence), pa.array(offset)], names=names)

    return ranked.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long, ids binary, sequence_id long, offset long")


def pack(docs: DataFrame, definition: str, end_id: int, capacity: int = CAPACITY, **options) -> DataFrame:
    """Tokenize, cut and pack: one row per piece, with its sequence and its place there."""
    return place(cut_pieces(docs, definition, end_id, capacity, **options), capacity)
