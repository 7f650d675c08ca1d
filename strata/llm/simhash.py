"""SimHash near-duplicates, compared bit-sliced.

Fingerprints are 64-bit majorities over the XXH64 hashes of word shingles. Two that
differ in at most ``radius`` bits agree on at least two of ``radius + 2`` blocks of bits,
so equal pairs of blocks bring all links together: no candidate is lost.

A group of candidates is held as 64 bit planes, one bit per fingerprint. Shifting the
planes by d lines every fingerprint up with the d-th after it; differing bits are added
to vertical counters by carry-save steps, 64 comparisons to a machine word. Words whose
64 counts all exceed the radius are abandoned, as are groups that are already connected.

Groups larger than a tile are cut into salted parts, and each pair of parts is compared
by a task of its own. A tile returns a spanning forest of its links, never all pairs.
Forests are joined into components by alternating large-star and small-star steps on
distributed tables; nothing of a document's size or number reaches the driver.

For a similarity of shingle sets far more bits would differ, and repeats of a shingle must
not count. There ``similar_documents`` works on the sets of distinct shingles in two steps:

* candidates: 256-bit SimHashes of the sets, compared as above. At a Jaccard similarity J
  of 0.8 large sets differ in 38.8 bits on average, sets of four and five members in 48, with
  a standard deviation of 6.2 at most, so a radius of 80 loses a pair with a probability
  below 3e-7. Blocks of bits can't bring pairs
  together at such a radius: sets meet if they agree in one of 28 bands of 5 min-wise
  functions, which happens with the probability 1 - (1 - J^5)^28, all but 2e-5 at 0.8;
* links: within the components of candidates, every pair that can reach the similarity
  (by its rarest shingles) is counted exactly, so none below it is ever linked.

Defined results. Null or empty text, or no words: fingerprint zero, linked like any
other. Fewer words than a shingle: one shingle of all words. Equal fingerprints are one
node, so copies are never paired. A component's id is the smallest id in it; null ids are
skipped unless all are null. Repeated rows stay. Very long texts are read whole; a task's
memory is in proportion to the longest one. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bound_batches, fresh, named, stash, with_struct

SHINGLE, RADIUS, SEED = 3, 3, 42
#: Fingerprints of a group that one part holds; a tile holds two parts.
TILE = 4096
#: Rows that a task compares at once, besides those of one tile.
ROWS_AT_ONCE = 1 << 15
#: For similarities: bands and min-wise functions of each; words of a SimHash and differing bits at most.
BANDS, BAND, WORDS, FAR = 28, 5, 4, 80
#: Keys with so many rows that they are joined by a broadcast: at most this many.
HUBS = 50_000
#: Shingles of a component of candidates that one part holds; a tile holds two parts.
PART = 1 << 20
#: Bits of a bitmap, as ``bitmap_construct_agg`` makes it.
BITMAP = 1 << 15
LOWER = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))


def shingles_of(text: bytes, size: int) -> list[bytes]:
    """Shingles, repeats included, of ``text`` with A-Z in lower case."""
    words = text.translate(LOWER).split()
    if len(words) <= size:
        return [b" ".join(words)] if words else []
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    stops = np.cumsum(lengths + 1) - 1
    starts = stops - lengths
    return [joined[a:b] for a, b in zip(starts[: len(words) - size + 1].tolist(), stops[size - 1 :].tolist(), strict=True)]


def fingerprint(text: bytes, size: int = SHINGLE, seed: int = SEED) -> int:
    """Unsigned 64 bits: a bit is set if it is set in over half of the hashes."""
    from xxhash import xxh64_intdigest

    hashes = np.array([xxh64_intdigest(s, seed) for s in shingles_of(text, size)], "<u8")
    counts = np.zeros(64, np.int64)
    for a in range(0, len(hashes), 1 << 14):
        bits = np.unpackbits(hashes[a : a + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<u8")[0])


def with_fingerprints(docs: DataFrame, text_col: str = "text", out: str = "simhash", size: int = SHINGLE) -> DataFrame:
    """``docs`` with the struct ``out``: ``fp``, as a signed 64-bit integer."""

    def work(texts: list[bytes]) -> dict:
        return {"fp": np.array([fingerprint(t, size) for t in texts], np.uint64).view(np.int64)}

    return with_struct(docs, text_col, out, T.StructType([T.StructField("fp", T.LongType())]), lambda: work)


def join_labels(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Join the components of ``a[i]`` and ``b[i]``; labels stay roots (least positions)."""
    while len(a):
        x, y = labels[a], labels[b]
        differ = x != y
        if not differ.any():
            return
        a, b, x, y = a[differ], b[differ], x[differ], y[differ]
        np.minimum.at(labels, np.maximum(x, y), np.minimum(x, y))
        while True:
            jumped = labels[labels]
            if (jumped == labels).all():
                break
            labels[:] = jumped


def components_of(fps: np.ndarray, sizes: np.ndarray, radius: int) -> np.ndarray:
    """Labels (a position in the same component) of ``fps``, dealt into groups of ``sizes``.

    ``fps`` has a row of one or more 64-bit words each. Only fingerprints of one group are compared. Groups must come largest first.
    """
    n, depth = len(fps), 64 * fps[:1].size
    labels = np.arange(n)
    if not n or sizes[0] < 2:
        return labels
    begins = np.cumsum(sizes) - sizes
    after = np.repeat(begins + sizes, sizes) - np.arange(n) - 1  # members that follow in the group
    words = -(-n // 64) + 1
    bits = np.zeros((depth, words * 64), np.uint8)
    bits[:, :n] = np.unpackbits(np.ascontiguousarray(fps).view(np.uint8).reshape(n, -1), axis=1, bitorder="little").T
    planes = np.packbits(bits, axis=1, bitorder="little").view("<u8")  # plane, word
    shifts = min(64, int(sizes[0]))
    shifted = np.empty((shifts, depth, words), np.uint64)
    shifted[0] = planes
    for r in range(1, shifts):
        shifted[r] = planes >> np.uint64(r)
        shifted[r, :, :-1] |= planes[:, 1:] << np.uint64(64 - r)
    width = radius.bit_length()
    cap = [bool((radius + 1) >> k & 1) for k in range(width + 1)]
    for q in range((int(sizes[0]) - 1) // 64 + 1):
        live_groups = np.flatnonzero(sizes > max(64 * q, 1))
        if not len(live_groups):
            break
        upto = int(begins[live_groups[-1]] + sizes[live_groups[-1]])
        here = -(-upto // 64)
        # Groups that are one component already need no more comparisons.
        open_ = np.maximum.reduceat(labels[:upto] != np.repeat(begins, sizes)[:upto], begins[begins < upto])
        wanted = np.repeat(open_, sizes[: len(open_)])[:upto]
        r = np.arange(shifts)[:, None]
        valid = np.zeros((shifts, here * 64), np.uint8)
        valid[:, :upto] = (after[:upto] >= 64 * q + r) & wanted & (64 * q + r > 0)
        alive = np.packbits(valid, axis=1, bitorder="little").view("<u8")
        at_r, at_w = np.nonzero(alive)
        alive = alive[at_r, at_w]
        fits = at_w + q < words  # beyond the last word there is no partner
        at_r, at_w, alive = at_r[fits], at_w[fits], alive[fits]
        counter = [np.zeros(len(alive), np.uint64) for _ in range(width + 1)]
        for p in range(depth):
            if not len(alive):
                break
            carry = shifted[at_r, p, at_w + q] ^ planes[p, at_w]
            for k in range(width + 1):  # carry-save: add one bit to the vertical counter
                counter[k], carry = counter[k] ^ carry, counter[k] & carry
            reached = np.full(len(alive), ~np.uint64(0))
            for k in range(width + 1):
                reached &= counter[k] if cap[k] else ~counter[k]
            alive = alive & ~reached  # a count passes radius + 1 one by one
            if p % 8 == 7:
                keep = alive != 0
                if not keep.all():
                    at_r, at_w, alive = at_r[keep], at_w[keep], alive[keep]
                    counter = [c[keep] for c in counter]
        if len(alive):
            row, bit = np.nonzero(np.unpackbits(alive.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
            a = at_w[row] * 64 + bit
            join_labels(labels, a, a + 64 * q + at_r[row])
    return labels


def blocks_of(radius: int) -> list[tuple[int, int]]:
    """(lowest bit, bits) of ``radius + 2`` blocks that cover 64 bits."""
    cuts = [64 * k // (radius + 2) for k in range(radius + 3)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:], strict=False)]


def _keys(fp: Column, radius: int) -> Column:
    """A key per pair of blocks: the table's number and the two blocks' bits."""
    out = []
    for k, ((a, m), (b, n)) in enumerate(combinations(blocks_of(radius), 2)):
        first = F.shiftrightunsigned(fp, a).bitwiseAND(F.lit((1 << m) - 1))
        second = F.shiftrightunsigned(fp, b).bitwiseAND(F.lit((1 << n) - 1))
        out.append(F.shiftleft(F.lit(k).cast("long"), m + n).bitwiseOR(F.shiftleft(first, n)).bitwiseOR(second))
    return F.array(*out)


def forest(fps: DataFrame, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """Edges (a, b) whose components are those of all links between the distinct ``fp`` of ``fps``."""
    keyed = fps.select("fp", F.explode(_keys(F.col("fp"), radius)).alias("key"))
    return _compared(keyed, fps.select("fp", F.col("fp").alias("w0")), radius, tile)


def spread_join(rows: DataFrame, values: DataFrame, key: str, total: int) -> DataFrame:
    """``rows`` joined with ``values`` (one row per key, and how many rows have it, as ``n``).

    A key with many of the ``total`` rows would meet in one task: there are at most HUBS
    such keys, so these are broadcast, and their rows stay where they are.
    """
    many = F.col("n") > max(1000, total // HUBS)
    hubs = F.broadcast(values.filter(many))
    near = rows.join(hubs, key)
    far = rows.join(F.broadcast(values.filter(many).select(key)), key, "left_anti").join(values.filter(~many), key)
    return near.unionByName(far).drop("n")


def _compared(keyed: DataFrame, nodes: DataFrame, radius: int, tile: int) -> DataFrame:
    """Edges between nodes ``fp`` that share a ``key`` and whose words (the other columns of ``nodes``) differ in few bits."""
    bound_batches(keyed.sparkSession)
    names = [c for c in nodes.columns if c != "fp"]
    words = len(names)
    # Most keys have one node; only the others carry words along.
    several = keyed.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
    met = keyed.join(several.hint("merge"), "key")
    if words > 1:
        met = met.join(nodes, "fp")
    else:
        met = met.withColumn(names[0], F.col("fp"))
    parts = F.ceil(F.col("n") / tile).cast("int")
    salted = met.select("key", "fp", *names, parts.alias("s"), F.pmod(F.xxhash64("fp"), parts).cast("int").alias("own"))
    pairs = F.when(F.col("s") == 1, F.array(F.struct(F.lit(0).alias("i"), F.lit(0).alias("j")))).otherwise(
        F.transform(F.filter(F.sequence(F.lit(0), F.col("s") - 1), lambda x: x != F.col("own")), lambda x: F.struct(F.least(x, F.col("own")).alias("i"), F.greatest(x, F.col("own")).alias("j")))
    )
    dealt = salted.select("key", "fp", *names, F.explode(pairs).alias("t")).select("key", "t.i", "t.j", "fp", *names)
    dealt = dealt.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")

    def compare(key: np.ndarray, fp: np.ndarray) -> pa.RecordBatch | None:
        change = np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1
        begins = np.concatenate([[0], change])
        sizes = np.diff(np.append(begins, len(fp)))
        order = np.argsort(-sizes, kind="stable")
        order = order[sizes[order] > 1]
        if not len(order):
            return None
        sizes, begins = sizes[order], begins[order]
        at = np.repeat(begins - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
        own = fp[at]
        labels = components_of(np.ascontiguousarray(own[:, 1:]).view(np.uint64), sizes, radius)
        linked = np.flatnonzero(labels != np.arange(len(own)))
        if not len(linked):
            return None
        return pa.RecordBatch.from_arrays([pa.array(own[linked, 0]), pa.array(own[labels[linked], 0])], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, fps_ = np.empty((0, 3), np.int64), np.empty((0, 1 + words), np.int64)
        for batch in batches:
            columns = [c.to_numpy().astype(np.int64) for c in batch.columns]
            keys = np.concatenate([keys, np.stack(columns[:3], axis=1)])
            fps_ = np.concatenate([fps_, np.stack(columns[3:], axis=1)])
            if len(fps_) < ROWS_AT_ONCE:
                continue
            change = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1))
            if not len(change):
                continue
            cut = change[-1] + 1  # the last group may go on
            if (got := compare(keys[:cut], fps_[:cut])) is not None:
                yield got
            keys, fps_ = keys[cut:], fps_[cut:]
        if len(fps_) and (got := compare(keys, fps_)) is not None:
            yield got

    return dealt.mapInArrow(run, "a long, b long").distinct()


def star_components(edges: DataFrame) -> DataFrame:
    """(node, root) of all nodes of ``edges`` (a, b); the root is a component's least node.

    Large-star and small-star steps alternate until nothing changes. Each step needs the
    least neighbour of each node: an aggregate with a partial stage, and a join by which
    the edges of a node with very many aren't gathered.
    """

    def state(df: DataFrame) -> tuple:
        r = df.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        return r.n, r.h

    def with_least(rows: DataFrame) -> DataFrame:
        least = rows.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))
        return spread_join(rows, least, "a", 2 * before[0])

    now = stash(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    before = state(now)
    while before[0]:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = with_least(both).filter("b > a").select(F.col("b").alias("a"), F.least("a", "m").alias("b")).distinct()
        small = with_least(large).select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct(F.col("a"), F.col("m").alias("b")))).alias("e"))
        now = stash(small.select("e.a", "e.b").filter("a <> b").distinct(), "stars")
        after = state(now)
        if after == before:
            break
        before = after
    return now.select(F.col("a").alias("node"), F.col("b").alias("root"))


def _components(printed: DataFrame, edges: DataFrame) -> DataFrame:
    """Per node ``fp`` of ``printed`` (doc_id, fp): its ``root``, ``component_id`` and number ``n`` of rows."""
    nodes = printed.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n"))
    roots = star_components(edges)
    # Written, as the joins below read them more than once.
    rooted = stash(nodes.join(roots, nodes.fp == roots.node, "left").select("fp", "least", F.col("n").alias("rows"), F.coalesce("root", "fp").alias("root")), "rooted")
    several = stash(rooted.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("n")).filter("n > 1"), "roots")
    alone = rooted.join(several.select("root"), "root", "left_anti").select("fp", "root", F.col("least").alias("component_id"), F.col("rows").alias("n"))
    joined = spread_join(rooted, several, "root", HUBS).select("fp", "root", "component_id", F.col("rows").alias("n"))
    return stash(alone.unionByName(joined), "components")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """One row per document: its id, ``fp`` and ``component_id``."""
    printed = with_fingerprints(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), "text", "simhash", size)
    printed = stash(printed.select("doc_id", F.col("simhash.fp").alias("fp")), "fingerprints")
    edges = forest(printed.select("fp").distinct(), radius, tile)
    return spread_join(printed, _components(printed, edges), "fp", printed.count()).select("doc_id", "fp", "component_id")


def shingle_set(text: bytes, size: int, seed: int = SEED) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct shingles."""
    from xxhash import xxh64_intdigest

    return np.unique(np.array([xxh64_intdigest(s, seed) for s in set(shingles_of(text, size))], np.uint64))


def bands_of(own: np.ndarray, seed: int = SEED) -> np.ndarray:
    """A key per band of min-wise functions over a set of hashes."""
    rng = np.random.default_rng(seed)
    flips, odd = rng.integers(0, 1 << 64, (2, BANDS * BAND), np.uint64)
    odd |= np.uint64(1)
    least = np.full(BANDS * BAND, ~np.uint64(0))
    for a in range(0, len(own), 256):
        np.minimum(least, ((own[a : a + 256, None] ^ flips) * odd).min(axis=0), out=least)
    keys = np.arange(BANDS, dtype=np.uint64)
    for column in least.reshape(BANDS, BAND).T:
        keys = (keys ^ column) * np.uint64(0xC2B2AE3D27D4EB4F)
        keys ^= keys >> np.uint64(29)
    return keys.view(np.int64)


def wide_fingerprint(own: np.ndarray) -> np.ndarray:
    """The SimHash of a set of hashes in WORDS words; each word is a majority over the hashes, mixed anew."""
    counts = np.zeros(64 * WORDS, np.int64)
    turns = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], np.uint64)[:WORDS]
    for a in range(0, len(own), 1 << 12):
        mixed = own[a : a + (1 << 12), None] * turns
        mixed = (mixed ^ mixed >> np.uint64(32)) * np.uint64(0xBF58476D1CE4E5B9)
        mixed ^= mixed >> np.uint64(29)
        counts += np.unpackbits(mixed.view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return np.packbits(2 * counts > len(own), bitorder="little").view(np.int64)


def with_sketches(docs: DataFrame, text_col: str, out: str, size: int) -> DataFrame:
    """``docs`` with the struct ``out``: ``fp`` (of the whole shingle set), SimHash words ``w0``, ... and ``bands``."""
    from xxhash import xxh64_intdigest

    names = [f"w{k}" for k in range(WORDS)]

    def work(texts: list[bytes]) -> dict:
        sets = [shingle_set(t, size) for t in texts]
        words = np.array([wide_fingerprint(s) for s in sets], np.int64).reshape(-1, WORDS)
        fps = np.array([xxh64_intdigest(s.tobytes(), SEED) for s in sets], np.uint64).view(np.int64)
        return {"fp": fps, "bands": [bands_of(s) for s in sets]} | {n: words[:, k].copy() for k, n in enumerate(names)}

    fields = [T.StructField(n, T.LongType()) for n in ("fp", *names)]
    return with_struct(docs, text_col, out, T.StructType([*fields, T.StructField("bands", T.ArrayType(T.LongType()))]), lambda: work)


def linked(sets: list[np.ndarray], similarity: float) -> np.ndarray:
    """Labels (a position in the same component) of sets, linked by exact Jaccard similarity.

    Two sets that reach it share one of their few rarest members. From each set found, the
    search goes on among those not yet found, so large components cost few comparisons.
    """
    labels, sizes = np.arange(len(sets)), np.array([len(s) for s in sets])
    members, of, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    rank = np.empty(len(members), np.int64)
    rank[np.argsort(times, kind="stable")] = np.arange(len(members))
    owner = np.repeat(labels, sizes)
    ranks = rank[of]
    ranks = ranks[np.lexsort((ranks, owner))]  # of each set, rarest first
    begins = np.cumsum(sizes) - sizes
    heads = np.minimum(sizes - np.ceil(similarity * sizes - 1e-9).astype(np.int64) + 1, sizes)
    in_head = np.arange(len(ranks)) - begins[owner] < heads[owner]

    def spread(a: np.ndarray, n: np.ndarray) -> np.ndarray:
        return np.repeat(a - (np.cumsum(n) - n), n) + np.arange(n.sum())

    def index() -> tuple[np.ndarray, np.ndarray]:
        use = in_head & free[owner]
        order = np.argsort(ranks[use], kind="stable")
        return ranks[use][order], owner[use][order]

    free, left, held = np.ones(len(sets), bool), len(sets), len(sets)
    named, holder = index()
    mark = np.zeros(len(members), np.int64)
    for seed in range(len(sets)):
        if not free[seed]:
            continue
        free[seed], left, queue = False, left - 1, [seed]
        while queue and left:
            i = queue.pop()
            if left < held / 2:
                (named, holder), held = index(), left
            own = ranks[begins[i] : begins[i] + sizes[i]]
            first = np.searchsorted(named, own[: heads[i]])
            near = np.unique(holder[spread(first, np.searchsorted(named, own[: heads[i]], "right") - first)])
            near = near[free[near] & (np.minimum(sizes[near], sizes[i]) >= similarity * np.maximum(sizes[near], sizes[i]) - 1e-9)]
            if not len(near):
                continue
            mark[own] = 1
            widths = sizes[near]
            common = np.add.reduceat(mark[ranks[spread(begins[near], widths)]], np.cumsum(widths) - widths)
            mark[own] = 0
            found = near[common >= similarity * (sizes[i] + widths - common) - 1e-9]
            labels[found], free[found], left = seed, False, left - len(found)
            queue += found.tolist()
    return labels


def _confirmed(members: DataFrame, size: int, similarity: float, tile: int, part: int) -> DataFrame:
    """Edges between nodes of one component of candidates whose sets reach the similarity.

    ``members``: root, fp, text, one row per node. Components larger than a part are cut
    into salted parts, and each pair of parts is compared by a task of its own.
    """

    def with_sets(texts: list[bytes]) -> dict:
        sets = [shingle_set(t, size) for t in texts]
        return {"hashes": [s.tobytes() for s in sets], "n": [len(s) for s in sets]}

    kind = T.StructType([T.StructField("hashes", T.BinaryType()), T.StructField("n", T.LongType())])
    sets = stash(with_struct(members, "text", "own", kind, lambda: with_sets).select("root", "fp", "own.hashes", "own.n"), "sets")
    parts = F.greatest(F.ceil(F.sum("n") / part), F.ceil(F.count("*") / tile)).cast("int")
    # Written, so that its size is known and sets stay in place where it is small.
    large = stash(sets.groupBy("root").agg(parts.alias("s")).filter("s > 1"), "large")
    salted = sets.join(large, "root", "left").withColumn("s", F.coalesce("s", F.lit(1))).withColumn("at", F.pmod(F.xxhash64("fp"), "s").cast("int"))
    pairs = F.when(F.col("s") == 1, F.array(F.struct(F.lit(0).alias("i"), F.lit(0).alias("j")))).otherwise(
        F.transform(F.filter(F.sequence(F.lit(0), F.col("s") - 1), lambda x: x != F.col("at")), lambda x: F.struct(F.least(x, F.col("at")).alias("i"), F.greatest(x, F.col("at")).alias("j")))
    )
    dealt = salted.select("root", "fp", "hashes", F.explode(pairs).alias("t")).select("root", "t.i", "t.j", "fp", "hashes")
    dealt = dealt.repartition("root", "i", "j").sortWithinPartitions("root", "i", "j")

    def edges(fps: list[int], own: list[bytes]) -> Iterator[pa.RecordBatch]:
        if len(fps) < 2:
            return
        labels = linked([np.frombuffer(h, np.uint64) for h in own], similarity)
        found = np.flatnonzero(labels != np.arange(len(labels)))
        if len(found):
            nodes = np.array(fps, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(nodes[found]), pa.array(nodes[labels[found]])], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, fps, own = None, [], []
        for batch in batches:
            for *key, fp, hashes in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if key != now:
                    yield from edges(fps, own)
                    now, fps, own = key, [], []
                fps.append(fp)
                own.append(hashes)
        yield from edges(fps, own)

    return dealt.mapInArrow(run, "a long, b long").distinct()


def _in_place(rows: DataFrame, row: Column, marked: DataFrame, out: str) -> DataFrame:
    """``rows`` with the boolean column ``out``: whether the number ``row`` is in ``marked`` (row).

    No row moves. What is broadcast is a bit per number, in bitmaps of 4 KB for 32768 numbers;
    every task that numbered rows begins a bitmap of its own, and those without a mark are left out.
    """
    at, bits = fresh(rows, "bitmap_at"), fresh(rows, "bitmap")
    place = F.col("row").bitwiseAND(F.lit(BITMAP - 1))
    maps = marked.groupBy(F.shiftright("row", BITMAP.bit_length() - 1).alias(at)).agg(F.bitmap_construct_agg(place).alias(bits))
    joined = rows.join(F.broadcast(maps), F.shiftright(row, BITMAP.bit_length() - 1) == F.col(at), "left")
    own = row.bitwiseAND(F.lit(BITMAP - 1)).cast("int")
    byte = F.conv(F.hex(F.substring(F.col(bits), F.shiftright(own, 3) + 1, F.lit(1))), 16, 10).cast("int")
    found = F.coalesce(F.getbit(byte, own.bitwiseAND(F.lit(7))) == 1, F.lit(False))
    return joined.withColumn(out, found).drop(at, bits)


def _similar(docs: DataFrame, id_col: str, text_col: str, size: int, similarity: float, tile: int, part: int) -> tuple[DataFrame, str, DataFrame]:
    """``docs`` stashed with sketches, the name of their column, and per set: fp, root, component_id, n.

    The sketch holds the number ``row`` of its row, which no other row has.
    """
    out = fresh(docs, "sketch")
    sketched = with_sketches(docs, text_col, out, size)
    printed = stash(sketched.withColumn(out, F.col(out).withField("row", F.monotonically_increasing_id())), "similar")
    words = [f"w{k}" for k in range(WORDS)]
    fp, row = F.col(f"{out}.fp").alias("fp"), F.col(f"{out}.row").alias("row")
    sketches = stash(printed.select(*[F.col(f"{out}.{c}") for c in ("fp", *words, "bands")]).dropDuplicates(["fp"]), "sketches")
    candidates = _compared(sketches.select("fp", F.explode("bands").alias("key")), sketches.select("fp", *words), FAR, tile)
    rooted = star_components(candidates)
    nodes = rooted.unionByName(rooted.select(F.col("root").alias("node"), "root").distinct())
    # One row of each set in a component gives its text; the texts of other rows stay in place.
    first = printed.select(fp, row).groupBy("fp").agg(F.min("row").alias("row")).join(nodes, F.col("fp") == F.col("node")).select("root", "row")
    first = stash(first, "members")
    texts = printed.select(fp, row, named(text_col).alias("text"))
    chosen = _in_place(texts, F.col("row"), first, "chosen").filter("chosen")
    members = chosen.join(first, "row").select("root", "fp", "text")
    ids = printed.select(named(id_col).alias("doc_id"), fp)
    return printed, out, _components(ids, _confirmed(members, size, similarity, tile, part))


def similar_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, similarity: float = 0.8, tile: int = TILE, part: int = PART) -> DataFrame:
    """Per row of ``docs``: doc_id, fp, root and component_id.

    Two documents link if the Jaccard similarity of their shingle sets is ``similarity``
    or more; groups are the components of all links. Candidates are tuned to 0.8 or more.
    """
    printed, out, groups = _similar(docs, id_col, text_col, size, similarity, tile, part)
    ids = printed.select(named(id_col).alias("doc_id"), F.col(f"{out}.fp").alias("fp"))
    return spread_join(ids, groups, "fp", ids.count()).select("doc_id", "fp", "root", "component_id")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, similarity: float = 0.8, tile: int = TILE, part: int = PART) -> DataFrame:
    """``docs`` with one document of each group of similar ones: that with the smallest id.

    Null ids come last. Of rows that share this id, in a group, the one with the least
    text stays, nulls first; of equal texts, the one with the least hash of its columns.
    Only ids travel until it is known which rows go. These are then taken out where they
    lie, and of all rows only those that share the id of the one that stays are moved.
    """
    printed, out, groups = _similar(docs, id_col, text_col, size, similarity, tile, part)
    ids = printed.select(named(id_col).alias("id"), F.col(f"{out}.fp").alias("fp"), F.col(f"{out}.row").alias("row"))
    grouped = stash(spread_join(ids, groups, "fp", ids.count()).select("id", "row", "root"), "grouped")
    # A group's rows with its smallest id, and those that are one too many.
    several = grouped.groupBy("root").agg(F.count("*").alias("n"), F.min(F.struct(F.col("id").isNull().alias("none"), "id")).alias("kept")).filter("n > 1")
    named_rows = stash(spread_join(grouped, stash(several, "several"), "root", HUBS), "named")
    loses = ~F.col("id").eqNullSafe(F.col("kept.id"))
    best = named_rows.filter(~loses).select("row", "root")
    tied = best.join(best.groupBy("root").agg(F.count("*").alias("rows")).filter("rows > 1").select("root"), "root").select("row", "root")
    tied = stash(tied.toDF("m_row", "m_root"), "tied")
    marks = stash(named_rows.filter(loses).select("row").unionByName(tied.select(F.col("m_row").alias("row"))), "marks")
    columns = [named(c) for c in docs.columns]
    hashed = [named(f.name) for f in docs.schema if not isinstance(f.dataType, T.MapType | T.VariantType)]
    order = F.struct(named(text_col), F.xxhash64(*hashed))
    rows = printed.select(F.struct(F.struct(*columns).alias("row"), F.col(f"{out}.row").alias("nth"), order.alias("order")).alias("r"))
    at = F.col("r.nth")
    stay = _in_place(rows, at, marks, "gone").filter("not gone").select("r.row")
    rivals = _in_place(rows, at, tied.select(F.col("m_row").alias("row")), "rival").filter("rival")
    last = rivals.join(tied, at == F.col("m_row")).groupBy("m_root").agg(F.min_by("r.row", "r.order").alias("row")).select("row")
    return stay.unionByName(last).select("row.*")
