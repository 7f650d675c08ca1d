"""LM scoring with a hierarchical Pitman-Yor model of words and their predecessors.

Each word seen before (the context) has a restaurant; all context restaurants share one
parent, the restaurant of words without context, whose own parent is uniform over the
known words and one unknown. Customers of a context are the words that follow it in the
training documents; each of its tables is a customer of the parent.

Seating is sampled by Gibbs in joint rounds. In a round every context's tables are drawn
anew, dish by dish, given all other counts (``pitman_yor.seat``); then the parent gets the
new tables as its customers, and its own tables are drawn. The state after such a round is
one joint sample. Predictive probabilities are averaged over the samples that are kept.
Within a round tasks see each other's counts as of the round before; a kept sample's
probabilities use its own counts throughout, so they add up to one, whatever the number of
buckets. Discounts are estimated from the numbers of types seen once and twice.

Every count covers all training documents. Pairs of words are dealt to buckets by hash:

1. documents are cut into chunks; a chunk sends each of its pairs once to the pair's
   bucket, with its training count;
2. buckets (cells of a grid of contexts and words) add up the pairs and send each of their
   words the sums that it takes part in: training count, customers, tables. Pairs seen once
   sit at one table for good; a bucket keeps only the others for the rounds;
3. rounds: words return their totals to buckets, which draw tables and send what changed;
4. chunks send their pairs again, now with the documents that hold them; buckets compute
   the averaged probabilities and return sums per document, which are added per chunk.

A pair that is common in a chunk travels once from there, and its probability comes back
by itself; so a very common word or pair costs each bucket one entry per chunk at most.
Rows between tasks are packed arrays, so that a pair takes some ten bytes.

Defined results. Null or empty text: the end token alone. A null id is learned from.
Repeated rows are learned from and scored one by one. Without training documents every
probability is 1. Very long texts are read whole: a chunk holds one text at least, and its
memory is in proportion. Other columns are left aside. An empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blobs import ROWS, by_group, chunks_of, dealt, pack, rows_of, slot, thick, thin, unpack
from .common import bound_batches, stash
from .pitman_yor import discount_of, seat

END = np.uint64(0)
CHUNK_BYTES = 16 << 20
#: Tokens of the corpus per bucket, about; occurrences from which a chunk treats a pair as common.
TOKENS_PER_BUCKET, COMMON = 2_000_000, 200
STRENGTH, ROOT_STRENGTH = 1.0, 10.0
#: Joint rounds that are left out and kept; sweeps over a task's entries in a round.
BURN, KEEP, SWEEPS, SEED = 1, 2, 2, 11
#: What buckets and words send each other in rounds; ``state`` is kept, ``sums`` are totals.
SENT = "bucket long, part int, seq int, blob binary, state binary, sums array<double>"
LOWER = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))
IN_WORD = np.array([b != 0x20 and not 0x09 <= b <= 0x0D for b in range(256)])


def pair_hash(context: np.ndarray, word: np.ndarray) -> np.ndarray:
    mixed = context * np.uint64(0x9E3779B97F4A7C15) ^ (word * np.uint64(0xC2B2AE3D27D4EB4F) + np.uint64(0x165667B19E3779F9))
    mixed = (mixed ^ mixed >> np.uint64(31)) * np.uint64(0xBF58476D1CE4E5B9)
    return mixed ^ mixed >> np.uint64(29)


def bucket_of(context: np.ndarray, word: np.ndarray, buckets: int) -> np.ndarray:
    """The bucket of a pair, by its cell in a grid of classes of contexts and classes of words.

    With twice the root of ``buckets`` classes on each side, a chunk names a word to few
    buckets, in either role, and a word with the share p of all pairs adds to a bucket no
    more than p / 2 times the root of ``buckets`` mean loads.
    """
    side = np.uint64(int(np.ceil(2 * np.sqrt(buckets))))
    row = (context * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)) % side
    column = (word * np.uint64(0xC2B2AE3D27D4EB4F) >> np.uint64(33)) % side
    return slot(pair_hash(row, column), buckets)


def sort_places(keys: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted ``keys``, all of them from 0 to below ``most``, and the places that they had; equal ones in order.

    Where a key and its place fit 64 bits together they are sorted as one number, which is
    several times as fast as sorting places.
    """
    width = max(1, len(keys) - 1).bit_length()
    if max(1, most - 1).bit_length() + width > 64:
        order = np.argsort(keys, kind="stable")
        return keys[order], order
    both = keys.astype(np.uint64) << np.uint64(width) | np.arange(len(keys), dtype=np.uint64)
    both.sort()
    return (both >> np.uint64(width)).astype(np.int64), (both & np.uint64((1 << width) - 1)).astype(np.int64)


def starts_of(keys: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin."""
    new = np.ones(len(keys), bool)
    np.not_equal(keys[1:], keys[:-1], out=new[1:])
    return np.flatnonzero(new)


def merged(hashes: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray]]:
    """All hashes of sorted arrays, sorted and once, and the places there of each array's."""
    found = np.sort(np.concatenate(hashes))
    found = found[starts_of(found)]
    return found, [np.searchsorted(found, h) for h in hashes]


def split_words(texts: list[bytes]) -> tuple[pa.Array, np.ndarray]:
    """The lower-cased words of all texts, and how many each text has."""
    data = np.frombuffer(b" ".join([*texts, b""]).translate(LOWER), np.uint8)
    inside = IN_WORD[data]
    edges = np.flatnonzero(inside[1:] != inside[:-1]) + 1  # words begin and end, by turns
    if len(data) and inside[0]:
        edges = np.concatenate([[0], edges])
    begins, ends = edges[::2], edges[1::2]
    offsets = np.concatenate([[0], np.cumsum(ends - begins)]).astype(np.int64)
    words = pa.Array.from_buffers(pa.large_binary(), len(begins), [None, pa.py_buffer(offsets), pa.py_buffer(data[inside])])
    return words, np.diff(np.searchsorted(begins, np.cumsum([len(t) + 1 for t in texts])), prepend=0)


class Chunk:
    """Documents as numbers of the chunk's own words; 0 is the end, and the context of a first word."""

    def __init__(self, texts: list[bytes], train: np.ndarray):
        from xxhash import xxh64_intdigest

        words, n_words = split_words(texts)
        words = words.dictionary_encode()
        hashes = np.array([0, *(xxh64_intdigest(w) | 1 for w in words.dictionary.to_pylist())], np.uint64)
        # Words are numbered in the order of their hashes, so sorted numbers are sorted hashes.
        order = np.argsort(hashes)
        self.hashes, rank = hashes[order], np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        self.lengths = n_words + 1
        word, is_word = np.zeros(self.lengths.sum(), np.int64), np.ones(self.lengths.sum(), bool)
        is_word[np.cumsum(self.lengths) - 1] = False
        word[is_word] = rank[1:][words.indices.to_numpy()]
        del words, is_word
        n = len(self.hashes)
        keys = word.copy()
        keys[1:] += word[:-1] * n
        del word
        # Occurrences by pair.
        keys, places = sort_places(keys, n * n)
        self.first = starts_of(keys)
        self.counts = np.diff(self.first, append=len(keys))
        self.doc = np.repeat(np.arange(len(self.lengths), dtype=np.int32), self.lengths)[places]
        self.trained = np.add.reduceat(train[self.doc].astype(np.int64), self.first)
        self.keys = keys[self.first]
        self.context, self.word = np.divmod(self.keys, n)

    def sent(self, buckets: int, with_docs: bool, common_from: int = COMMON) -> Iterator[tuple[int, bytes]]:
        """(bucket, blob) for all buckets that have pairs of this chunk."""
        bucket = bucket_of(self.hashes[self.context], self.hashes[self.word], buckets)
        order = np.argsort(bucket.astype(np.uint16) if buckets <= 1 << 16 else bucket, kind="stable")
        cuts = starts_of(bucket[order])
        place = np.empty(len(self.hashes), np.int64)
        if with_docs:
            common = self.counts >= common_from
            self.common = np.flatnonzero(common)
            pseudo = np.zeros(len(self.keys), np.int64)
            pseudo[self.common] = len(self.lengths) + np.arange(len(self.common))
        for own in np.split(order, cuts[1:]):
            context, word = self.context[own], self.word[own]  # sorted by context
            runs = starts_of(context)
            contexts = context[runs]
            known = np.sort(np.concatenate([contexts, word]))
            known = known[starts_of(known)]
            place[known] = np.arange(len(known))
            arrays = [thin(self.hashes[known]), np.diff(place[contexts], prepend=0), np.diff(runs, append=len(own)), place[word], self.trained[own]]
            if with_docs:
                times = np.where(common[own], 1, self.counts[own])
                total = np.cumsum(times)
                at = np.repeat(self.first[own] - (total - times), times) + np.arange(total[-1])
                docs = self.doc[at].astype(np.int64)
                single = total[common[own]] - 1
                docs[single] = pseudo[own[common[own]]]
                arrays += [times, docs]
            yield int(bucket[own[0]]), pack(*arrays)

    def common_counts(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(document, number of the common pair, occurrences)."""
        which = np.full(len(self.keys), -1)
        which[self.common] = np.arange(len(self.common))
        token = np.repeat(which, self.counts)
        held = token >= 0
        keys, n = np.unique(self.doc[held].astype(np.int64) * max(1, len(self.common)) + token[held], return_counts=True)
        doc, k = np.divmod(keys, max(1, len(self.common)))
        return doc, k, n


class Pairs:
    """A bucket's distinct pairs by context and word, their training counts, and its distinct words, sorted."""

    def __init__(self, blobs: list[list[np.ndarray]]):
        self.words, places = merged([thick(b[0]) for b in blobs])
        n = len(self.words)
        keys = np.concatenate([np.repeat(own[np.cumsum(b[1].astype(np.int64))], b[2]) * n + own[b[3]] for own, b in zip(places, blobs, strict=True)])
        keys, order = sort_places(keys, n * n)
        first = starts_of(keys)
        self.of_entry = np.empty(len(keys), np.int64)
        self.of_entry[order] = np.repeat(np.arange(len(first)), np.diff(first, append=len(keys)))
        self.c = np.add.reduceat(np.concatenate([b[4] for b in blobs]).astype(np.float64)[order], first)
        self.context, self.word = np.divmod(keys[first], n)

    def sums(self) -> list[np.ndarray]:
        """Per word: training count, customers as a context, tables of pairs seen once as a word and as a context."""
        n, once = len(self.words), (self.c == 1).astype(float)
        pairs = ((self.word, self.c), (self.context, self.c), (self.word, once), (self.context, once))
        return [np.bincount(i, w, n).astype(np.int64) for i, w in pairs]

    def open(self) -> np.ndarray:
        """Pairs whose tables are sampled: those seen more than once."""
        return np.flatnonzero(self.c > 1)


class Parent:
    """The parent's probabilities from a sample's customers and tables of words and in all."""

    def __init__(self, known: float, customers: float, tables: float, discount: float):
        self.customers, self.discount = customers, discount
        self.new = (ROOT_STRENGTH + discount * tables) / (known + 1)

    def of(self, customers: np.ndarray, tables: np.ndarray) -> np.ndarray:
        return (customers - self.discount * tables + self.new) / (ROOT_STRENGTH + self.customers)


def sample_parent(k: np.ndarray, known: float, tables: float, discount: float, rng: np.random.Generator) -> np.ndarray:
    """The parent's tables of a task's words with ``k`` customers each; ``tables``: of all words before."""
    t = np.minimum(k, 1)
    elsewhere = tables * (1 - np.count_nonzero(k) / max(known, 1))
    much = np.full(len(k), 1e18)  # a constant chance of 1 / (known + 1)
    for _ in range(SWEEPS):
        t = seat(k, np.maximum(elsewhere + t.sum() - t, 0), much / (known + 1), much, discount, ROOT_STRENGTH, rng)
    return t


def sample_tables(c: np.ndarray, context: np.ndarray, word: np.ndarray, t: np.ndarray, parent: Parent, customers: np.ndarray, tables: np.ndarray, own: np.ndarray, discount: float, rng: np.random.Generator) -> np.ndarray:
    """New tables of a bucket's open pairs.

    Per word: ``customers`` and ``tables`` in the parent, tables ``own`` as a context, all
    as of the last exchange, where the pairs had ``t`` tables.
    """
    n = len(own)
    as_context, as_word = own - np.bincount(context, t, n), customers - np.bincount(word, t, n)
    for _ in range(SWEEPS):
        half = rng.random(len(c)) < 0.5
        for part in (np.flatnonzero(half), np.flatnonzero(~half)):
            now = t[part]
            others = (as_context + np.bincount(context, t, n))[context[part]] - now
            k = (as_word + np.bincount(word, t, n))[word[part]] - now
            held = np.maximum(np.minimum(tables[word[part]], k), 1)
            t = t.copy()
            t[part] = seat(c[part], others, k - parent.discount * held + parent.new, ROOT_STRENGTH + parent.customers - now, discount, STRENGTH, rng)
    return t


def predictive(c: np.ndarray, t: np.ndarray, context: np.ndarray, customers: np.ndarray, tables: np.ndarray, parent: np.ndarray, discount: float) -> np.ndarray:
    """Each pair's probability in one sample; ``parent``: that of its word in the parent."""
    return (c - discount * t + (STRENGTH + discount * tables[context]) * parent) / (STRENGTH + customers[context])


def is_held_out(doc_id: int | None) -> bool:
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 7 == 2


def _send(docs: DataFrame, buckets: int, with_docs: bool, chunk_bytes: int, common_from: int) -> DataFrame:
    """Packed pairs of every chunk, by bucket; with documents, also a row about each chunk (seq < 0)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        for seq, (ids, texts) in enumerate(chunks_of(batches, chunk_bytes)):
            held = np.array([is_held_out(i) for i in ids])
            chunk = Chunk(texts, ~held)
            del texts
            for bucket, blob in chunk.sent(buckets, with_docs, common_from):
                yield rows_of([(bucket, part, seq, blob)])
            if with_docs:
                known = np.array([i is not None for i in ids])
                about = pack(np.array([i or 0 for i in ids], np.int64), known, held, chunk.lengths, *chunk.common_counts(), np.array([len(chunk.common)]))
                yield rows_of([((part * 7919 + seq) % buckets, part, -1 - seq, about)])

    return docs.mapInArrow(run, ROWS)


def sent_rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.list_(pa.float64()))
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=[f.split()[0] for f in SENT.split(", ")])


def _totals(sent: DataFrame, n: int) -> list[float]:
    """The sums of ``sums``: one row comes to the driver."""
    return [x or 0.0 for x in sent.agg(*[F.sum(F.col("sums")[i]) for i in range(n)]).first()]


def score_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = SEED, tokens_per_bucket: int = TOKENS_PER_BUCKET, chunk_bytes: int = CHUNK_BYTES, common_from: int = COMMON) -> DataFrame:
    """Per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    spark = docs.sparkSession
    bound_batches(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("i"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    size = rows.agg(F.sum(F.octet_length("t").cast("long"))).first()[0] or 0
    buckets = int(size // 6 // tokens_per_bucket) + 1

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (bucket,), group in by_group(batches, 1):
            pairs = Pairs([unpack(r[3]) for r in group])
            own = pairs.open()
            used, at = np.unique(np.concatenate([pairs.context[own], pairs.word[own]]), return_inverse=True)
            c = pairs.c[own].astype(np.int64)
            state = pack(c, at[: len(own)], at[len(own) :], np.ones(len(own), np.int64))
            yield sent_rows([(-1, int(bucket), 0, None, state, [float((pairs.c == 1).sum()), float((c == 2).sum())])])
            sums, to = pairs.sums(), slot(pairs.words, buckets)
            sums += [np.bincount(x, minlength=len(pairs.words)) for x in (pairs.word[own], pairs.context[own])]
            is_open = np.zeros(len(to), bool)
            is_open[used] = True
            for k, cut in slices(to):
                yield sent_rows([(k, int(bucket), 0, pack(thin(pairs.words[cut]), *(x[cut] for x in sums[:4]), is_open[cut], *(x[cut][is_open[cut]] for x in sums[4:])), None, None)])

    def slices(to: np.ndarray) -> Iterator[tuple[int, slice]]:
        """Sorted slots, and where each one's words lie."""
        ends = np.searchsorted(to, np.arange(buckets + 1))
        for k in np.flatnonzero(np.diff(ends)):
            yield int(k), slice(int(ends[k]), int(ends[k + 1]))

    # Sums of all buckets' words, and each bucket's open pairs.
    named = stash(dealt(_send(rows, buckets, False, chunk_bytes, common_from), buckets, "bucket", "part", "seq").mapInArrow(add_up, SENT), "pairs")
    names = named.filter("bucket >= 0").select("bucket", F.lit(0).alias("kind"), "part", "seq", "blob")
    states = named.filter("bucket = -1").select(F.col("part").cast("long").alias("bucket"), F.lit(0).alias("kind"), "part", "seq", F.col("state").alias("blob"))
    types = _totals(named, 2)
    d = discount_of(*types)

    def exchange(nth: int, known: float, root_d: float, before: float) -> Callable:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for (to,), group in by_group(batches, 1):
                sent = [(r[2], unpack(r[4])) for r in group if r[1] == 0]
                changed = {r[2]: unpack(r[4]) for r in group if r[1] == 1}
                words, where = merged([thick(b[0]) for _, b in sent])
                n, of = len(words), np.concatenate(where)
                count, customers, tables, own = (np.bincount(of, np.concatenate([b[j] for _, b in sent]), n).astype(np.int64) for j in range(1, 5))
                asked = [of_own[b[5]] for of_own, (_, b) in zip(where, sent, strict=True)]
                for at, (part, b) in zip(asked, sent, strict=True):
                    as_word, as_context = changed.get(part, b[6:]) if nth else b[6:]
                    tables[at] += as_word.astype(np.int64)  # a bucket names a word once
                    own[at] += as_context.astype(np.int64)
                t = sample_parent(tables, known, before, root_d, np.random.default_rng([seed, 1, nth, int(to)])) if nth else np.minimum(tables, 1)
                for at, (part, _) in zip(asked, sent, strict=True):
                    if len(at):
                        yield sent_rows([(part, int(to), 0, pack(tables[at], t[at], own[at]), None, None)])
                totals = [count.sum(), (count > 0).sum(), tables.sum(), t.sum(), (tables == 1).sum(), (tables == 2).sum()]
                yield sent_rows([(-1, int(to), nth, None, pack(count, customers, tables, t, own), [float(x) for x in totals])])

        return run

    def draw(nth: int, parent: Parent) -> Callable:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for (bucket,), group in by_group(batches, 1):
                c, context, word, t = (x.astype(np.int64) for x in unpack(next(r[4] for r in group if r[1] == 0)))
                if not len(c):
                    continue
                t = next((unpack(r[4])[0].astype(np.int64) for r in group if r[1] == 2), t)
                got = [(r[2], unpack(r[4])) for r in group if r[1] == 1]
                customers, tables, own = (np.concatenate([b[j] for _, b in got]).astype(np.int64) for j in range(3))
                t = sample_tables(c, context, word, t, parent, customers, tables, own, d, np.random.default_rng([seed, 2, nth, int(bucket)]))
                yield sent_rows([(-1, int(bucket), nth, None, pack(t), None)])
                sums, at = [np.bincount(x, t, len(own)).astype(np.int64) for x in (word, context)], 0
                for to, b in got:
                    yield sent_rows([(int(to), int(bucket), 1, pack(*(x[at : at + len(b[0])] for x in sums)), None, None)])
                    at += len(b[0])

        return run

    def blobs_of(df: DataFrame, kind: int) -> DataFrame:
        return df.filter("bucket >= 0").select("bucket", F.lit(kind).alias("kind"), "part", "seq", "blob")

    def kept(df: DataFrame, kind: int) -> DataFrame:
        return df.filter("bucket = -1").select(F.col("part").cast("long").alias("bucket"), F.lit(kind).alias("kind"), "part", "seq", F.col("state").alias("blob"))

    words = stash(dealt(names, buckets, "bucket", "kind", "part").mapInArrow(exchange(0, 0, 0, 0), SENT), "words")
    n, v, k, t0, *types = _totals(words, 6)
    root_d = discount_of(*types)
    samples: list[tuple[Parent, DataFrame, DataFrame]] = []
    drawn = None
    for nth in range(1, BURN + KEEP + 1 if n else 1):
        sent = states.unionByName(blobs_of(words, 1))
        if drawn is not None:
            sent = sent.unionByName(kept(drawn, 2))
        drawn = stash(dealt(sent, buckets, "bucket", "kind", "part").mapInArrow(draw(nth, Parent(v, k, t0, root_d)), SENT), "tables")
        sent = names.unionByName(blobs_of(drawn, 1))
        words = stash(dealt(sent, buckets, "bucket", "kind", "part").mapInArrow(exchange(nth, v, root_d, t0), SENT), "words")
        _, _, k, t0, *_ = _totals(words, 6)
        if nth > BURN:
            samples.append((Parent(v, k, t0, root_d), words, drawn))
    parents = [p for p, *_ in samples]

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (to,), group in by_group(batches, 1):
            sent = [(r[2], thick(unpack(r[4])[0])) for r in group if r[1] == 0]
            states = [unpack(r[4]) for r in group if r[1] == 1]  # of all samples
            for (part, _), cut in zip(sent, merged([h for _, h in sent])[1], strict=True):
                yield rows_of([(part, int(to), 0, pack(*(x[cut] for x in states[0][:2]), *(x[cut] for s in states for x in s[2:])))])

    last = [w for _, w, _ in samples] or [words]
    asked = names
    for w in last:
        asked = asked.unionByName(kept(w, 1))
    answers = dealt(asked, buckets, "bucket", "kind", "part", "seq").mapInArrow(answer, ROWS)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (bucket,), group in by_group(batches, 1):
            got = [unpack(r[4]) for r in group if r[1] == 0]
            for r in group:
                if r[1] == 2 and r[3] < 0:
                    yield rows_of([(0, r[2], r[3], r[4])])
            sent = [(r[2], r[3], unpack(r[4])) for r in group if r[1] == 2 and r[3] >= 0]
            if not sent:
                continue
            pairs = Pairs([b for *_, b in sent])
            count, customers, *rest = (np.concatenate([b[j] for b in got]).astype(float) for j in range(len(got[0])))
            p, own = np.zeros(len(pairs.c)), pairs.open()
            drawn = [unpack(r[4])[0] for r in group if r[1] == 1]
            for nth, parent in enumerate(parents):
                words, tables, as_context = rest[3 * nth : 3 * nth + 3]
                t = np.minimum(pairs.c, 1)
                if len(own):
                    t[own] = drawn[nth]
                p += predictive(pairs.c, t, pairs.context, customers, as_context, parent.of(words, tables)[pairs.word], d) / len(parents)
            logp = np.log10(p) if parents else p
            base, known = np.log10((count + 1) / (n + v + 1)), (count > 0).astype(float)
            at = 0
            for part, seq, b in sent:
                pair = np.repeat(pairs.of_entry[at : at + len(b[4])], b[5])
                at += len(b[4])
                docs_, order = sort_places(b[6], int(b[6].max()) + 1)
                pair, first = pair[order], starts_of(docs_)
                word = pairs.word[pair]
                found = (np.add.reduceat(x, first) for x in (logp[pair], base[word], known[word]))
                yield rows_of([(0, part, seq, pack(docs_[first], *found))])

    both = answers.select("bucket", F.lit(0).alias("kind"), "part", "seq", "blob")
    for *_, tables in samples:
        both = both.unionByName(kept(tables, 1))
    both = both.unionByName(_send(rows, buckets, True, chunk_bytes, common_from).select("bucket", F.lit(2).alias("kind"), "part", "seq", "blob"))
    sums = dealt(both, buckets, "bucket", "kind", "seq", "part").mapInArrow(score, ROWS)

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, group in by_group(batches, 2):
            about = next(r for r in group if r[2] < 0)
            ids, has_id, held, lengths, doc, nth, times, common = unpack(about[3])
            score = np.zeros((3, len(ids) + int(common[0])))
            for r in group:
                if r[2] >= 0:
                    at, *got = unpack(r[3])
                    for line, x in zip(score, got, strict=True):
                        line[at] += x
            doc, nth = doc.astype(np.int64), nth.astype(np.int64)
            score, single = score[:, : len(ids)], score[:, len(ids) :]
            for line, x in zip(score, single, strict=True):
                line += np.bincount(doc, times * x[nth], len(ids))
            columns = [
                pa.array(ids.astype(np.int64), mask=~has_id), pa.array(held), pa.array(lengths.astype(np.int64)), pa.array(np.round(score[2]).astype(np.int64)),
                pa.array(np.full(len(ids), int(n))), pa.array(score[1]), pa.array(score[0]),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    chunks = sums.select("part", F.when(F.col("seq") < 0, -1 - F.col("seq")).otherwise(F.col("seq")).cast("int").alias("chunk"), "seq", "blob")
    chunks = chunks.repartition("part", "chunk").sortWithinPartitions("part", "chunk", "seq")
    return chunks.mapInArrow(total, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
