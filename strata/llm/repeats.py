"""Repeated passages, found with a run-length compressed suffix index (r-index).

A byte goes if it lies in a string of ``length`` bytes that also starts earlier, in a
document with a smaller id or before in its own. The steps:

1. In each string of ``length`` bytes the 16 bytes with the least hash are its anchor;
   equal strings have equal anchors at equal places. Successive strings with one anchor
   form a context, which travels as two hashes.
2. Where contexts are equal, all but the earliest are repeats as a whole. Where several
   differ around an anchor, their bytes are needed: they are sent to the anchor's first
   document, so neighbouring contexts of a document join to long segments there.
   Strings with 16 bytes in them that are unique there can't repeat and drop out.
3. Segments of earlier documents are indexed: suffixes are sorted, the Burrows-Wheeler
   transform is kept as runs, with suffix positions at both ends of each run. Segments
   of later documents are streamed through the index from their ends: a step either
   continues a match by an LF mapping or moves to the nearest run with the wanted byte,
   above or below, whichever sample matches longer. Starts with matching statistics of
   ``length`` or more are repeats.

Earlier means among all documents of a first document's group, so groups are halved again
and again, from pairs upward: the right half is streamed against the index of the left
half, and strings that are found leave. Indexes have a bounded size; a larger half is indexed piece by piece.

Repeats within one document share an anchor there and are compared directly.

Defined results. Null or empty text: no bytes, nothing removed. Null ids come first, and
rows with equal ids follow each other by their places in the input; each counts as a
document of its own. An empty table gives no rows. Kept bytes may start or end inside a
character, so they are binary. What must fit a task's memory: the differing contexts of
one anchor, less than 200 bytes a document, and a document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blobs import ROWS, by_group, chunks_of, dealt, pack, rows_of, slot, unpack
from .common import bound_batches, stash
from .tokens import groups_of

LENGTH, GRAM = 100, 16
CHUNK_BYTES, TOGETHER = 8 << 20, 2 << 20
#: Bytes of text per bucket of contexts, and of segments per bucket of the index.
BYTES_PER_BUCKET, SEGMENTS_PER_BUCKET = 24 << 20, 2 << 20
#: Bytes that one index holds at most, but for a single longer segment; starts of a streamed lane.
INDEXED, LANE = 4 << 20, 400
#: Spreads hashes of anchors, which are least ones, over all slots.
SPREAD = np.uint64(0x9E3779B97F4A7C15)


def eights(data: bytes, beyond: int = 0) -> np.ndarray:
    """The eight bytes from each position on as a number; ``beyond`` positions more than bytes."""
    n = len(data) + beyond
    padded = np.frombuffer(data + b"\xff" * (beyond + 16), np.uint8)
    out = np.empty(n, np.uint64)
    for k in range(min(8, n)):
        own = out[k::8]
        own[:] = padded[k : k + 8 * len(own)].copy().view("<u8")
    return out


def gram_hashes(data: bytes) -> np.ndarray:
    """A hash of the 16 bytes from each position on."""
    words = eights(data, 8)
    h = words[: len(data)] * np.uint64(0x9E3779B97F4A7C15) ^ words[8:] * np.uint64(0xC2B2AE3D27D4EB4F)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ h >> np.uint64(32)


def contexts_of(texts: list[bytes], length: int = LENGTH) -> tuple[np.ndarray, ...]:
    """(anchor hash, document, first start, last start) of the contexts of all texts, in order.

    Runs of texts are taken at once: their bytes cost about fifty times their number in memory.
    """
    found = []
    for a, b in groups_of(texts, TOGETHER):
        anchor, doc, lo, hi = _contexts(texts[a:b], length)
        found.append((anchor, doc + a, lo, hi))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else _contexts([], length)


def _contexts(texts: list[bytes], length: int) -> tuple[np.ndarray, ...]:
    lengths = np.array([len(t) for t in texts], np.int64)
    ends = np.cumsum(lengths)
    data = b"".join(texts)
    if len(data) < length:
        return tuple(np.empty(0, k) for k in (np.uint64, np.int64, np.int64, np.int64))
    h = gram_hashes(data)
    # The low half of a key is the position: ties go to the leftmost.
    least = (h & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(h), dtype=np.uint64)
    width, span = length - GRAM + 1, 1
    while span * 2 <= width:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    if width > span:
        least = np.minimum(least[: len(least) - (width - span)], least[width - span :])
    anchor = (least & np.uint64(0xFFFFFFFF)).astype(np.int64)
    start = np.arange(len(anchor))
    doc = np.repeat(np.arange(len(texts)), lengths)[: len(anchor)]
    inside = start + length <= ends[doc]
    start, anchor, doc = start[inside], anchor[inside], doc[inside]
    new = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1])])) if len(start) else np.empty(0, np.int64)
    last = np.append(new[1:], len(start))[: len(new)] - 1
    begin = (ends - lengths)[doc[new]]
    return h[anchor[new]], doc[new], start[new] - begin, start[last] - begin


class Index:
    """r-index of segments. A segment's bytes are symbols of its own tag; 0 ends a segment."""

    def __init__(self, segments: list[bytes], tags: list[int]):
        sizes = np.array([len(s) + 1 for s in segments], np.int64)
        data = b"".join(s + b"\xff" for s in segments)
        plain = np.frombuffer(data, np.uint8).astype(np.int64) + 1
        stops = np.cumsum(sizes) - 1
        plain[stops] = 0
        tag = np.repeat(np.array(tags, np.int64), sizes)
        text = np.where(plain > 0, symbols_of(plain - 1, tag), 0)
        self.eights = eights(data)
        order = suffix_array(plain, tag, np.repeat(stops, sizes))
        before = text[order - 1]
        heads = np.flatnonzero(np.concatenate([[True], before[1:] != before[:-1]]))
        self.starts = heads
        self.stops = np.append(heads[1:], len(plain)) - 1
        self.symbols = before[heads]
        # Positions of suffixes are kept at both ends of each run only.
        self.first, self.last = order[self.starts], order[self.stops]
        self.by_symbol = np.argsort(self.symbols, kind="stable")
        sizes = (self.stops - self.starts + 1)[self.by_symbol]
        self.shift = np.empty(len(heads), np.int64)
        self.shift[self.by_symbol] = np.cumsum(sizes) - sizes
        self.shift -= self.starts
        self.keys = self.symbols[self.by_symbol] * len(heads) + self.by_symbol

    def statistics(self, query: np.ndarray, query_eights: np.ndarray, ends: np.ndarray, sizes: np.ndarray, cap: int) -> np.ndarray:
        """Matching statistics, ``cap`` at most, of all positions of the lanes.

        Lane i is ``query[ends[i] - sizes[i] : ends[i]]``; lanes come longest first.
        ``query_eights`` has the bytes behind the symbols.
        """
        out = np.zeros(len(query), np.int16)
        runs, n = len(self.starts), len(self.eights)
        row, place, length = (np.zeros(len(ends), np.int64) for _ in range(3))
        for step in range(int(sizes[0]) if len(sizes) else 0):
            live = int(np.searchsorted(-sizes, -step, side="left"))  # lanes longer than step
            at = ends[:live] - 1 - step
            wanted = query[at]
            run = np.searchsorted(self.starts, row[:live], side="right") - 1
            follows = (self.symbols[run] == wanted) & (length[:live] > 0)
            jump = np.flatnonzero(~follows)
            length[:live][follows] += 1
            if len(jump):
                c, r = wanted[jump], run[jump]
                below = np.searchsorted(self.keys, c * runs + r)
                best = np.full(len(jump), -1)
                to_row, to_place = np.zeros(len(jump), np.int64), np.zeros(len(jump), np.int64)
                for nth, rows, places in ((below - 1, self.stops, self.last), (below, self.starts, self.first)):
                    there = self.by_symbol[np.clip(nth, 0, runs - 1)]
                    ok = np.flatnonzero((nth >= 0) & (nth < runs) & (self.symbols[there] == c))
                    common = self._common(places[there[ok]], query_eights, at[jump[ok]] + 1, length[jump[ok]])
                    better = common > best[ok]
                    own = ok[better]
                    best[own], to_row[own], to_place[own] = common[better], rows[there[own]], places[there[own]]
                found = best >= 0
                row[jump[found]], place[jump[found]] = to_row[found], to_place[found]
                length[jump] = best + 1
                run[jump[found]] = np.searchsorted(self.starts, to_row[found], side="right") - 1
            moved = np.flatnonzero(length[:live] > 0)
            row[moved] += self.shift[run[moved]]
            place[moved] = (place[moved] - 1) % n
            np.minimum(length[:live], cap, out=length[:live])
            out[at] = length[:live]
        return out

    def _common(self, places: np.ndarray, query: np.ndarray, at: np.ndarray, most: np.ndarray) -> np.ndarray:
        """Common bytes of the text from ``places`` and the query from ``at``, ``most`` at most.

        Runs with a lane's symbol lie in segments of its tag, so bytes tell enough; the
        byte that ends a segment is none of UTF-8.
        """
        out = np.zeros(len(places), np.int64)
        live = np.flatnonzero(most > 0)
        last, last_at = len(self.eights) - 1, len(query) - 1
        while len(live):
            k = out[live]
            differ = self.eights[np.minimum(places[live] + k, last)] ^ query[np.minimum(at[live] + k, last_at)]
            same = np.where(differ == 0, 8, np.bitwise_count((differ & (~differ + np.uint64(1))) - np.uint64(1)) >> 3)
            out[live] += same
            live = live[(same == 8) & (out[live] < most[live])]
        return np.minimum(out, most)


def symbols_of(plain: np.ndarray, tag: np.ndarray | int) -> np.ndarray:
    return tag * 256 + plain + 1


def suffix_array(plain: np.ndarray, tag: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """Suffixes in order, by prefix doubling; only those not yet told apart are sorted again.

    ``plain`` has bytes plus one and 0 at the end of a segment, which lies at ``stops``;
    tags come before bytes. Suffixes that are equal up to that end follow their places.
    """
    n = len(plain)
    left = stops - np.arange(n)
    depth = max(1, (62 - int(tag.max()).bit_length()) // 9)
    key = np.where(left > 0, tag + 1, 0)
    padded = np.concatenate([plain, np.zeros(depth, np.int64)])
    for k in range(depth):
        key = key << 9 | np.where(left >= k, padded[k : k + n], 0)
    order = np.argsort(key, kind="stable")
    ranked = key[order]
    head = np.concatenate([[True], ranked[1:] != ranked[:-1]]) | (left[order] < depth)
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(head, np.arange(n), 0))
    while True:
        open_ = np.flatnonzero(~(head & np.append(head[1:], True)))
        if not len(open_):
            return order
        own = order[open_]
        # Suffixes that are alike so far have not met their end: the rest begins in their segment.
        again = np.lexsort((rank[own + depth], rank[own]))
        own = own[again]
        order[open_] = own
        first, second = rank[own], rank[own + depth]
        new = np.concatenate([[True], (first[1:] != first[:-1]) | (second[1:] != second[:-1])])
        head[open_] = new
        rank[own] = np.maximum.accumulate(np.where(new, open_, 0))
        depth *= 2


def possible_starts(segments: list[bytes], group: np.ndarray, length: int) -> np.ndarray:
    """Places in the joined segments at which a repeat can start.

    All its grams, 16 bytes each, must occur twice or more in the segment's group.
    """
    sizes = np.array([len(s) for s in segments], np.int64)
    ends = np.repeat(np.cumsum(sizes), sizes)
    place = np.arange(len(ends))
    inside = place + GRAM <= ends
    key = gram_hashes(b"".join(segments)) ^ np.repeat(group.astype(np.uint64) * SPREAD, sizes)
    _, nth, counts = np.unique(key[inside], return_inverse=True, return_counts=True)
    single = np.zeros(len(ends) + 1, np.int64)
    single[1:][inside] = counts[nth] == 1
    single = np.cumsum(single)
    whole = np.flatnonzero(place + length <= ends)
    return whole[single[whole + length - GRAM + 1] == single[whole]]


def repeats_among(segments: list[bytes], rank: np.ndarray, group: np.ndarray, length: int = LENGTH, indexed: int = INDEXED) -> list[np.ndarray]:
    """Per segment, the starts of strings that a segment of the same group and a lower rank holds.

    What is found leaves: an earlier holder of the string stays, and of each half the
    first holder, so later levels only see strings that are new in their half.
    """
    sizes = np.array([len(s) for s in segments], np.int64)
    begins = np.cumsum(sizes) - sizes
    filled = np.flatnonzero(sizes)  # empty segments share a place with the next one
    found: list[list[np.ndarray]] = [[] for _ in segments]

    def cut(starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
        """Segment, first start and bytes of each run of successive starts in a segment."""
        owner = filled[np.searchsorted(begins[filled], starts, side="right") - 1]
        new = np.flatnonzero(np.concatenate([[True], (np.diff(starts) != 1) | (np.diff(owner) != 0)]))
        of = owner[new]
        first = starts[new] - begins[of]
        last = starts[np.append(new[1:], len(starts)) - 1] - begins[of]
        return of, first, [segments[i][a : b + length] for i, a, b in zip(of.tolist(), first.tolist(), last.tolist(), strict=True)]

    starts = possible_starts(segments, group, length) if segments else np.empty(0, np.int64)
    level = 0
    while len(starts):
        of, first, pieces = cut(starts)
        hits, deepest = _level(pieces, rank[of], group[of], level, length, indexed)
        gone = []
        for k, places in enumerate(hits):
            if places:
                places = np.unique(np.concatenate(places)) + first[k]
                found[of[k]].append(places)
                gone.append(places + begins[of[k]])
        level += 1
        if not deepest >> level:
            break
        if gone:
            starts = starts[~np.isin(starts, np.concatenate(gone))]
            if len(starts):  # a string whose other holders have all left can't repeat any more
                of, first, pieces = cut(starts)
                left = possible_starts(pieces, group[of], length)
                at = np.cumsum([0, *map(len, pieces[:-1])])
                piece = np.searchsorted(at, left, side="right") - 1
                starts = left - at[piece] + first[piece] + begins[of[piece]]
    return [np.unique(np.concatenate(f)) if f else np.empty(0, np.int64) for f in found]


def _level(pieces: list[bytes], rank: np.ndarray, group: np.ndarray, level: int, length: int, indexed: int) -> tuple[list[list[np.ndarray]], int]:
    """Hits of the right halves of all pairs of this level in their left halves; the highest rank."""
    hits: list[list[np.ndarray]] = [[] for _ in pieces]
    half, pair = rank >> level, rank >> (level + 1)
    order = np.lexsort((rank, pair, group))
    partners: dict[tuple, list[int]] = {}
    keys = list(zip(group.tolist(), pair.tolist(), strict=True))
    right = half % 2 == 1
    for i in order[right[order]].tolist():
        partners.setdefault(keys[i], []).append(i)
    batch: list[int] = []
    held = 0
    # Pairs in runs that one index holds; a long left half makes several.
    for i in order[~right[order]].tolist():
        if keys[i] not in partners:
            continue
        if batch and held + len(pieces[i]) > indexed:
            _stream(pieces, batch, partners, group, pair, length, hits)
            batch, held = [], 0
        batch.append(i)
        held += len(pieces[i])
    if batch:
        _stream(pieces, batch, partners, group, pair, length, hits)
    return hits, int(rank.max())


def _stream(segments: list[bytes], left: list[int], partners: dict, group: np.ndarray, pair: np.ndarray, length: int, found: list[list[np.ndarray]]) -> None:
    """Index the left segments; stream the right halves of their pairs."""
    # Halves of different pairs must not match: each pair has a tag, its bytes are other symbols.
    tag = {k: n for n, k in enumerate(dict.fromkeys((int(group[i]), int(pair[i])) for i in left))}
    tag_of = lambda i: tag[int(group[i]), int(pair[i])]
    index = Index([segments[i] for i in left], [tag_of(i) for i in left])
    right = [i for k in tag for i in partners[k]]
    for a in range(0, len(right), 8000):
        own = right[a : a + 8000]
        data = b"".join(segments[i] for i in own)
        tags = np.repeat(np.array([tag_of(i) for i in own]), [len(segments[i]) for i in own])
        query = symbols_of(np.frombuffer(data, np.uint8).astype(np.int64), tags)
        ahead = eights(data)
        sizes = np.array([len(segments[i]) for i in own])
        begins = np.cumsum(sizes) - sizes
        cuts = [(b + x, min(LANE + length - 1, n - x), i, x) for i, b, n in zip(own, begins.tolist(), sizes.tolist(), strict=True) for x in range(0, max(1, n - length + 1), LANE)]
        cuts.sort(key=lambda c: -c[1])
        # Lanes overlap, so each has its own copy of the query.
        lanes = np.array([c[1] for c in cuts])
        ends = np.cumsum(lanes)
        source = np.repeat(np.array([c[0] for c in cuts]) - (ends - lanes), lanes) + np.arange(ends[-1])
        hits = np.flatnonzero(index.statistics(query[source], ahead[source], ends, lanes, length) >= length)
        lane = np.searchsorted(ends, hits, side="right")
        for k in np.flatnonzero(np.bincount(lane, minlength=len(cuts))):
            x, y = np.searchsorted(lane, [k, k + 1])
            found[cuts[k][2]].append(hits[x:y] - (ends[k] - lanes[k]) + cuts[k][3])


def _runs(starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first, number) of runs of successive numbers."""
    new = np.concatenate([[0], np.flatnonzero(np.diff(starts) != 1) + 1])
    return starts[new], np.append(new[1:], len(starts)) - new


def _split(data: np.ndarray, lengths: np.ndarray) -> list[bytes]:
    raw, ends = data.tobytes(), np.cumsum(lengths).tolist()
    return [raw[b - int(n) : b] for b, n in zip(ends, lengths.tolist(), strict=True)]


def _documents(blob: bytes) -> tuple[np.ndarray, ...]:
    ids, known, lengths, data = unpack(blob)
    return ids.astype(np.int64), known, lengths.astype(np.int64), data


def _local(texts: list[bytes], length: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Contexts that leave the chunk, and repeats that the chunk knows by itself.

    Documents must come in their order. Contexts: anchor hash, context hash, document,
    first start, number of starts. Repeats: document, first start, number of starts.
    """
    from xxhash import xxh64_intdigest

    anchor, doc, lo, hi = contexts_of(texts, length)
    digest = np.array([xxh64_intdigest(texts[d][a : b + length]) for d, a, b in zip(doc.tolist(), lo.tolist(), hi.tolist(), strict=True)], np.uint64)
    order = np.lexsort((np.arange(len(doc)), digest, anchor))
    same = np.zeros(len(doc), bool)
    a, b = order[:-1], order[1:]
    same[b] = (anchor[a] == anchor[b]) & (digest[a] == digest[b])
    repeats = [(doc[same], lo[same], hi[same] - lo[same] + 1)]
    kept = np.flatnonzero(~same)
    # An anchor that comes again within a document, with different contexts: compare strings.
    order = kept[np.lexsort((lo[kept], doc[kept], anchor[kept]))]
    twin = np.flatnonzero((anchor[order[1:]] == anchor[order[:-1]]) & (doc[order[1:]] == doc[order[:-1]]))
    seen: dict[tuple[int, int], set[bytes]] = {}
    own = []
    for i in order[np.unique(np.concatenate([twin, twin + 1]))].tolist() if len(twin) else []:
        text, strings = texts[doc[i]], seen.setdefault((int(anchor[i]), int(doc[i])), set())
        for s in range(int(lo[i]), int(hi[i]) + 1):
            string = text[s : s + length]
            if string in strings:
                own.append((int(doc[i]), s))
            strings.add(string)
    if own:
        found = np.array(own)
        repeats.append((found[:, 0], found[:, 1], np.ones(len(found), np.int64)))
    return [anchor[kept], digest[kept], doc[kept], lo[kept], (hi - lo + 1)[kept]], [np.concatenate(x) for x in zip(*repeats, strict=True)]


def find_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, chunk_bytes: int = CHUNK_BYTES, bytes_per_bucket: int = BYTES_PER_BUCKET, segments_per_bucket: int = SEGMENTS_PER_BUCKET) -> DataFrame:
    """Per document: doc_id, n_bytes, n_removed, n_spans, ``kept`` (binary)."""
    bound_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("i"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    size = rows.agg(F.sum(F.octet_length("t").cast("long"))).first()[0] or 0
    buckets = int(size // bytes_per_bucket) + 1

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        for seq, (ids, texts) in enumerate(chunks_of(batches, chunk_bytes)):
            order = sorted(range(len(ids)), key=lambda k, ids=ids: (ids[k] is not None, ids[k] or 0, k))
            ids, texts = [ids[k] for k in order], [texts[k] for k in order]
            blob = pack(np.array([i or 0 for i in ids], np.int64), np.array([i is not None for i in ids]), np.array([len(t) for t in texts], np.int64), np.frombuffer(b"".join(texts), np.uint8))
            yield rows_of([(0, part, seq, blob)])

    chunks = stash(rows.mapInArrow(store, ROWS), "chunks")

    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, group in by_group(batches, 4):
            for _, part, seq, blob in group:
                ids, known, lengths, data = _documents(blob)
                (anchor, digest, doc, lo, n), repeats = _local(_split(data, lengths), length)
                to = slot(anchor * SPREAD, buckets)
                order = np.argsort(to, kind="stable")
                cuts = np.flatnonzero(np.diff(to[order], prepend=-1))
                for own in np.split(order, cuts[1:]) if len(order) else []:
                    there, nth = np.unique(doc[own], return_inverse=True)
                    yield rows_of([(int(to[own[0]]), part, seq, pack(anchor[own], digest[own], nth, lo[own], n[own], there, ids[there].astype(np.int64), known[there]))])
                yield rows_of([((part * 7919 + seq) % buckets, part, -1 - seq, pack(*repeats))])

    def group_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, group in by_group(batches, 1):
            for r in group:
                if r[2] < 0:
                    yield rows_of([(0, r[1], -1 - r[2], r[3])])
            sent = [(r[1], r[2], unpack(r[3])) for r in group if r[2] >= 0]
            if sent:
                yield from _compare_contexts(sent)

    # Rows of bucket 0 hold repeats, those of bucket 1 ask for bytes.
    answers = stash(dealt(chunks.mapInArrow(anchors, ROWS), buckets, "bucket", "part", "seq").mapInArrow(group_up, ROWS), "contexts")

    def cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (part, seq), group in by_group(((b.select(["part", "seq", "bucket", "blob"])) for b in batches), 2):
            asked = [unpack(r[3]) for r in group if r[2] == 1]
            if not asked:
                continue
            ids, known, lengths, data = _documents(next(r[3] for r in group if r[2] == 0))
            begin = np.cumsum(lengths) - lengths
            first, doc, lo, n = (np.concatenate([x[j] for x in asked]).astype(np.uint64 if j == 0 else np.int64) for j in range(4))
            order = np.lexsort((lo, doc, first))
            first, doc, lo, stop = first[order], doc[order], lo[order], (lo + n + length - 1)[order]
            # Contexts of a document that touch become one segment.
            new = np.concatenate([[True], (first[1:] != first[:-1]) | (doc[1:] != doc[:-1]) | (lo[1:] > stop[:-1])])
            at = np.flatnonzero(new)
            stop = np.maximum.reduceat(stop, at)
            first, doc, lo = first[at], doc[at], lo[at]
            to = slot(first * SPREAD, sections)
            order = np.argsort(to, kind="stable")
            cuts = np.flatnonzero(np.diff(to[order], prepend=-1))
            raw = data.tobytes()
            for own in np.split(order, cuts[1:]):
                a, b = (begin[doc[own]] + lo[own]).tolist(), (begin[doc[own]] + stop[own]).tolist()
                body = np.frombuffer(b"".join(raw[x:y] for x, y in zip(a, b, strict=True)), np.uint8)
                yield rows_of([(int(to[own[0]]), part, seq, pack(first[own], doc[own], lo[own], (stop - lo)[own], ids[doc[own]].astype(np.int64), known[doc[own]], body))])

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, group in by_group(batches, 1):
            yield from _search(group, length)

    wanted = answers.filter("bucket = 1")
    asked_bytes = wanted.agg(F.sum(F.length("blob"))).first()[0] or 0
    sections = int(asked_bytes * 12 // segments_per_bucket) + 1
    both = chunks.unionByName(wanted).repartition("part", "seq").sortWithinPartitions("part", "seq", "bucket")
    segments = both.mapInArrow(cut_out, ROWS)
    matched = stash(dealt(segments, sections, "bucket", "part", "seq").mapInArrow(index, ROWS), "matches")

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, group in by_group(((b.select(["part", "seq", "kind", "blob"])) for b in batches), 2):
            ids, known, lengths, data = _documents(next(r[3] for r in group if r[2] == 0))
            begin = np.cumsum(lengths) - lengths
            sent = [unpack(r[3]) for r in group if r[2] == 1]
            doc, start, stop = _merged(*(np.concatenate([x[j] for x in sent] or [lengths[:0]]).astype(np.int64) for j in range(3)), length)
            # Runs of two documents may touch: one's end and the other's start cancel out.
            edge = np.zeros(len(data) + 1, np.int8)
            edge[begin[doc] + start] += 1
            edge[begin[doc] + stop] -= 1
            kept_bytes = data[np.cumsum(edge[:-1], dtype=np.int8) == 0].tobytes()
            spans = np.bincount(doc, minlength=len(ids))
            removed = np.bincount(doc, stop - start, len(ids)).astype(np.int64)
            kept_at = begin - (np.cumsum(removed) - removed)
            kept = [kept_bytes[a : a + n] for a, n in zip(kept_at.tolist(), (lengths - removed).tolist(), strict=True)]
            for a in range(0, len(ids), 2000):
                cut = slice(a, a + 2000)
                columns = [pa.array(ids[cut].astype(np.int64), mask=~known[cut]), pa.array(lengths[cut].astype(np.int64)), pa.array(removed[cut].astype(np.int64)), pa.array(spans[cut].astype(np.int64)), pa.array(kept[cut], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    known = answers.filter("bucket = 0").unionByName(matched).withColumn("kind", F.lit(1))
    last = chunks.withColumn("kind", F.lit(0)).unionByName(known).repartition("part", "seq").sortWithinPartitions("part", "seq", "kind")
    return last.mapInArrow(finish, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


def _merged(doc: np.ndarray, first: np.ndarray, n: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """(document, start, stop) of the maximal runs of bytes under strings that start at ``first``, ..., n each."""
    order = np.lexsort((first, doc))
    doc, start, stop = doc[order], first[order], (first + n + (length - 1))[order]
    if not len(doc):
        return doc, start, stop
    # Places beyond all of a document's separate it from the next one.
    base = doc * (int(stop.max()) + 1)
    reach = np.maximum.accumulate(base + stop)
    new = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (base[1:] + start[1:] > reach[:-1])]))
    return doc[new], start[new], reach[np.append(new[1:], len(doc)) - 1] - base[new]


def _order(ids: np.ndarray, known: np.ndarray, chunk: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Keys that sort documents: null ids first, then ids, then places in the input."""
    rank = np.empty(len(ids), np.int64)
    order = np.lexsort((doc, chunk, ids, known))
    a, b = order[:-1], order[1:]
    new = np.concatenate([[0], (ids[a] != ids[b]) | (known[a] != known[b]) | (chunk[a] != chunk[b]) | (doc[a] != doc[b])]) if len(order) else np.empty(0, int)
    rank[order] = np.cumsum(new)
    return rank


def _compare_contexts(sent: list[tuple[int, int, list[np.ndarray]]]) -> Iterator[pa.RecordBatch]:
    """Of a bucket's contexts: repeats as a whole, and those whose bytes have to be compared."""
    sizes = [len(b[0]) for *_, b in sent]
    chunk = np.repeat(np.arange(len(sent)), sizes)
    anchor, digest = (np.concatenate([b[j].astype(np.uint64) for *_, b in sent]) for j in (0, 1))
    doc, ids, known = (np.concatenate([b[j][b[2]] for *_, b in sent]) for j in (5, 6, 7))
    doc, ids = doc.astype(np.int64), ids.astype(np.int64)
    lo, n = (np.concatenate([b[j] for *_, b in sent]).astype(np.int64) for j in (3, 4))
    order = np.lexsort((lo, _order(ids, known, chunk, doc), anchor))
    new = np.concatenate([[True], anchor[order[1:]] != anchor[order[:-1]]])
    member = np.cumsum(new) - 1
    by_text = order[np.lexsort((np.arange(len(order)), digest[order], member))]
    a, b = by_text[:-1], by_text[1:]
    same = np.zeros(len(order), bool)
    same[b] = (anchor[a] == anchor[b]) & (digest[a] == digest[b])
    first = order[np.flatnonzero(new)][member]  # each anchor's first context, in sorted order
    # Anchors with two or more differing contexts in different documents.
    own = ~same[order]
    several = np.bincount(member, own) > 1
    asked = order[own & several[member]]
    key = np.empty(len(order), np.uint64)
    key[order] = ((chunk[first] << 32) | doc[first]).astype(np.uint64)
    parts = np.array([[p, s] for p, s, _ in sent], np.uint64)
    home = parts[(key >> np.uint64(32)).astype(np.int64)]
    key = (home[:, 0] << np.uint64(44)) ^ (home[:, 1] << np.uint64(24)) ^ (key & np.uint64(0xFFFFFFFF))
    cut = np.searchsorted(chunk[np.sort(asked)], np.arange(len(sent) + 1))
    asked = np.sort(asked)
    gone = np.flatnonzero(same)
    ends = np.searchsorted(chunk[gone], np.arange(len(sent) + 1))
    for k, (part, seq, _) in enumerate(sent):
        x, y = gone[ends[k] : ends[k + 1]], asked[cut[k] : cut[k + 1]]
        if len(x):
            yield rows_of([(0, part, seq, pack(doc[x], lo[x], n[x]))])
        if len(y):
            yield rows_of([(1, part, seq, pack(key[y], doc[y], lo[y], n[y]))])


def _search(group: list[tuple], length: int) -> Iterator[pa.RecordBatch]:
    """Repeats among the segments of one bucket."""
    sent = [(r[1], r[2], unpack(r[3])) for r in group]
    chunk = np.repeat(np.arange(len(sent)), [len(b[0]) for *_, b in sent])
    first = np.concatenate([b[0].astype(np.uint64) for *_, b in sent])
    doc, lo, sizes, ids = (np.concatenate([b[j] for *_, b in sent]).astype(np.int64) for j in (1, 2, 3, 4))
    known = np.concatenate([b[5] for *_, b in sent])
    segments = [s for *_, b in sent for s in _split(b[6], b[3].astype(np.int64))]
    member = np.unique(first, return_inverse=True)[1]
    # Ranks count a group's documents in order; segments of one document never meet.
    place = _order(ids, known, chunk, doc)
    order = np.lexsort((place, member))
    a, b = order[:-1], order[1:]
    new_group = np.concatenate([[True], member[a] != member[b]])
    new_doc = np.concatenate([[True], (member[a] != member[b]) | (place[a] != place[b])])
    count = np.cumsum(new_doc) - 1
    rank = np.empty(len(order), np.int64)
    rank[order] = count - np.maximum.accumulate(np.where(new_group, count, 0))
    found = repeats_among(segments, rank, member, length)
    for k, (part, seq, _) in enumerate(sent):
        out = []
        for i in np.flatnonzero(chunk == k).tolist():
            if len(found[i]):
                start, n = _runs(found[i])
                out.append((np.full(len(start), doc[i]), start + lo[i], n))
        if out:
            yield rows_of([(0, part, seq, pack(*(np.concatenate(x) for x in zip(*out, strict=True))))])
