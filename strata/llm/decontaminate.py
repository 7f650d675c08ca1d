"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

The alphabet is the benchmark's vocabulary: each document word becomes its number there,
or 0 if no benchmark item has it. Patterns of one length share a machine:

* the shift table, indexed by the hash of a block of two words, tells how far the search
  may skip from a position (a word outside the vocabulary skips a whole pattern);
* where the shift is 0, the hash bucket of the block lists the patterns that end with it;
* a pattern's words are then compared directly, so hash collisions cost time only.

The search runs over many lanes of a batch at once, each lane skipping for itself.

Defined results. Null or empty text: no words, no hits. Null or empty item: no window. A
null item id counts as one item, written as the empty string. Equal windows of several
items hit for all of them; rows with equal ids are one item. Repeated documents are
judged one by one. Very long texts are read whole; memory is in proportion to a batch, and
for the benchmark to a block: about 260 bytes of the driver and 105 of a broadcast for each of
its words, an item being whole in
one block. Other columns pass through. Empty tables give empty results or clean documents.
"""

from __future__ import annotations

from itertools import repeat

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_arrow, named, stash, with_struct

_SEPARATORS = [*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]
#: Lower-cases A-Z; every byte that is no word character becomes a space.
WORD_BYTES = bytes(0x20 if b in set(_SEPARATORS) else b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))

#: Words of benchmark text that one machine, and so one broadcast, holds at most.
BLOCK_WORDS = 500_000
LANE = 256
CHECKED_AT_ONCE = 1_000_000

HITS = T.StructType([
    T.StructField("n_words", T.LongType()),
    T.StructField("n_hit", T.LongType()),
    T.StructField("spans", T.ArrayType(T.ArrayType(T.LongType()))),
    T.StructField("items", T.ArrayType(T.StringType())),
])


def words_of(text: bytes) -> list[bytes]:
    return text.translate(WORD_BYTES).split()


class Machine:
    """Wu-Manber tables for patterns of ``m`` words each (rows of ``patterns``)."""

    def __init__(self, patterns: np.ndarray):
        self.patterns = patterns
        n, self.m = patterns.shape
        self.block = min(2, self.m)
        bits = int(np.clip(np.ceil(np.log2(8 * n * self.m)), 12, 24))
        self.cut = np.uint64(64 - bits)
        self.shift = np.full(1 << bits, self.m - self.block + 1, np.int16)
        for end in range(self.block - 1, self.m):
            before = patterns[:, end - 1] if self.block == 2 else None
            np.minimum.at(self.shift, self._hash(before, patterns[:, end]), np.int16(self.m - 1 - end))
        last = self._hash(patterns[:, -2] if self.block == 2 else None, patterns[:, -1])
        self.members = np.argsort(last, kind="stable").astype(np.int32)
        self.starts = np.searchsorted(last[self.members], np.arange((1 << bits) + 1)).astype(np.int32)

    def _hash(self, before: np.ndarray | None, word: np.ndarray) -> np.ndarray:
        mixed = word.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        if before is not None:
            mixed ^= before.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
        mixed ^= mixed >> np.uint64(29)
        return ((mixed * np.uint64(0xBF58476D1CE4E5B9)) >> self.cut).astype(np.int64)

    def candidates(self, ids: np.ndarray) -> np.ndarray:
        """End positions whose shift is 0."""
        first = np.arange(0, len(ids), LANE)
        until = np.minimum(first + LANE, len(ids))
        at = np.maximum(first, self.m - 1)
        found = []
        live = at < until
        at, until = at[live], until[live]
        while len(at):
            word = ids[at]
            skip = self.shift[self._hash(ids[at - 1] if self.block == 2 else None, word)].astype(np.int64)
            skip[word == 0] = self.m
            zero = skip == 0
            found.append(at[zero])
            at = at + np.maximum(skip, 1)
            live = at < until
            at, until = at[live], until[live]
        return np.concatenate(found) if found else np.empty(0, np.int64)

    def search(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(start positions, pattern rows) of all occurrences."""
        ends = self.candidates(ids)
        if not len(ends):
            return np.empty(0, np.int64), np.empty(0, np.int64)
        bucket = self._hash(ids[ends - 1] if self.block == 2 else None, ids[ends])
        size = (self.starts[bucket + 1] - self.starts[bucket]).astype(np.int64)
        starts, rows = [], []
        cuts = np.searchsorted(np.cumsum(size), np.arange(0, size.sum() + CHECKED_AT_ONCE, CHECKED_AT_ONCE)).tolist()
        for a, b in zip(cuts, [*cuts[1:], len(ends)], strict=True):
            if a == b:
                continue
            n = size[a:b]
            begin = np.repeat(ends[a:b] - self.m + 1, n)
            within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            row = self.members[np.repeat(self.starts[bucket[a:b]], n) + within].astype(np.int64)
            for j in range(self.m):  # from the prefix on, direct comparison
                same = ids[begin + j] == self.patterns[row, j]
                begin, row = begin[same], row[same]
            starts.append(begin)
            rows.append(row)
        return (np.concatenate(starts), np.concatenate(rows)) if starts else (np.empty(0, np.int64), np.empty(0, np.int64))


class Matcher:
    """Machines by pattern length over one block of the benchmark."""

    def __init__(self, items: list[tuple[str, bytes]], window: int):
        self.vocabulary: dict[bytes, int] = {}
        self.names: list[str] = []
        by_length: dict[int, tuple[list[np.ndarray], list[np.ndarray]]] = {}
        for name, text in items:
            words = words_of(text)
            if not words:
                continue
            ids = np.fromiter((self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words), np.int32, len(words))
            m = min(window, len(words))
            windows, owners = by_length.setdefault(m, ([], []))
            windows.append(np.lib.stride_tricks.sliding_window_view(ids, m))
            owners.append(np.full(len(windows[-1]), len(self.names)))
            self.names.append(name)
        self.machines = []
        for windows, owners in by_length.values():
            patterns, row = np.unique(np.concatenate(windows), axis=0, return_inverse=True)
            # Each pattern's items, once each, in one array.
            pairs = np.unique(row.ravel() * len(self.names) + np.concatenate(owners))
            counts = np.bincount(pairs // len(self.names), minlength=len(patterns))
            self.machines.append((Machine(patterns), np.concatenate([[0], np.cumsum(counts)]), pairs % len(self.names)))

    def scan(self, texts: list[bytes], before: list[dict] | None) -> dict[str, list]:
        get = self.vocabulary.get
        parts, lengths = [], []
        for text in texts:
            words = words_of(text)
            lengths.append(len(words))
            parts += [np.fromiter(map(get, words, repeat(0)), np.int32, len(words)), np.zeros(1, np.int32)]
        ids = np.concatenate(parts) if parts else np.empty(0, np.int32)
        first = np.concatenate([[0], np.cumsum(np.array(lengths, np.int64) + 1)])
        edge = np.zeros(len(ids) + 1, np.int32)
        items: list[set[str]] = [set() for _ in texts]
        for machine, owned, owners in self.machines:
            starts, rows = machine.search(ids)
            if not len(starts):
                continue
            edge += np.bincount(starts, minlength=len(edge)).astype(np.int32)
            edge -= np.bincount(starts + machine.m, minlength=len(edge)).astype(np.int32)
            n = owned[rows + 1] - owned[rows]
            doc = np.repeat(np.searchsorted(first, starts, side="right") - 1, n)
            owner = owners[np.repeat(owned[rows], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
            for key in np.unique(doc * len(self.names) + owner).tolist():
                items[key // len(self.names)].add(self.names[key % len(self.names)])
        for i, past in enumerate(before or []):
            if past:
                items[i].update(past["items"])
                for a, b in past["spans"]:
                    edge[first[i] + a] += 1
                    edge[first[i] + b] -= 1
        hit = np.cumsum(edge[:-1]) > 0
        step = np.diff(hit.astype(np.int8), prepend=0, append=0)
        opens, closes = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
        docs = np.searchsorted(first, opens, side="right") - 1
        spans: list[list[list[int]]] = [[] for _ in texts]
        for d, a, b in zip(docs.tolist(), opens.tolist(), closes.tolist(), strict=True):
            spans[d].append([a - int(first[d]), b - int(first[d])])
        return {
            "n_words": lengths,
            "n_hit": [sum(b - a for a, b in s) for s in spans],
            "spans": spans,
            "items": [sorted(x) for x in items],
        }


def find_contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    window: int = 10,
    out: str = "leak",
    block_words: int = BLOCK_WORDS,
) -> DataFrame:
    """``docs`` with the struct ``out``: n_words, n_hit, spans of hit words, item ids.

    The benchmark is a stated query set: it is searched in blocks of at most about
    ``block_words`` words (an item is never cut), each broadcast in turn, against all
    documents. Documents are never shuffled; between blocks they rest in a written table.
    """
    spark = docs.sparkSession
    items = benchmark.select(
        F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("id"),
        F.coalesce(F.col(item_text_col), F.lit("")).alias("body"),
    )
    chars = items.agg(F.sum(F.length("body"))).first()[0] or 0
    blocks = int(chars // 2 // block_words) + 1  # a word and its separator take two characters at least
    block_of = F.pmod(F.xxhash64("id", "body"), F.lit(blocks))
    state = docs.select(*[named(c) for c in docs.columns if c.lower() != out.lower()])
    for k in range(blocks):
        rows = items.filter(block_of == k).collect()
        sent = spark.sparkContext.broadcast(Matcher([(r.id, r.body.encode()) for r in rows], window))
        if k == 0:
            state = with_struct(state, text_col, out, HITS, lambda sent=sent: lambda texts: sent.value.scan(texts, None))
        else:
            state = stash(state, "leak")
            before.unpersist()
            state = _again(state, text_col, out, sent)
        before = sent
    return state


def _again(state: DataFrame, text_col: str, out: str, sent) -> DataFrame:
    """One more block: earlier hits are carried in the struct itself."""
    import pyarrow as pa

    text, past = state.columns.index(text_col), state.columns.index(out)

    def run(batches):
        for batch in batches:
            kind = batch.schema.field(past).type
            texts = [t or b"" for t in batch.column(text).cast(pa.binary()).to_pylist()]
            got = sent.value.scan(texts, batch.column(past).to_pylist())
            made = pa.StructArray.from_arrays([pa.array(got[f.name], f.type) for f in kind], fields=list(kind))
            yield pa.RecordBatch.from_arrays([made if i == past else c for i, c in enumerate(batch.columns)], names=batch.schema.names)

    return map_arrow(state, run, state.schema.fields)
