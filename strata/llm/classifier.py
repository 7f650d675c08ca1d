"""Quality classifier: a byte-level convolutional network in numpy.

A document's UTF-8 bytes are cut into overlapping chunks that cover all of it. Each byte
has a learned embedding; learned filters slide over a chunk and each filter keeps its
maximum there, over the windows that start in the text and end no later than its last
byte, rounded up to a stride. Over the document's chunks, the maximum and the mean of
these feed one hidden layer and one probability.

It is trained by one task on a bounded sample: the ``sample_rows`` labelled rows with the
least hashes of their ids (fewer if there are fewer), up to the row with which their texts
reach ``SAMPLE_BYTES``. Only the network comes to the driver. Every text, in training as in scoring, is read whole and
pooled over the same windows of all of its chunks.

Defined results. Null or empty text: one chunk of padding, which has a score like any
other. Rows with a null label, or a null id, are not learned from; of repeated ids each
labelled row counts. Without any usable label, or with one class only, the score is the
share of label 1 in the sample (0.5 if it is empty). An empty table gives no rows.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bound_batches, with_struct

CHUNK, OVERLAP, WIDTH, STRIDE = 1024, 64, 8, 4
EMBEDDING, FILTERS, HIDDEN = 8, 48, 16
PAD = 256
SAMPLE_ROWS, SAMPLE_BYTES, PASSES, LEAST_STEPS, BATCH, SEED = 4_000, 32 << 20, 12, 400, 64, 7
#: Chunks that are pooled at once.
SCORED_AT_ONCE = 256


@dataclass
class Network:
    emb: np.ndarray  # (257, EMBEDDING)
    conv: np.ndarray  # (WIDTH * EMBEDDING, FILTERS)
    bias: np.ndarray
    w1: np.ndarray  # (2 * FILTERS, HIDDEN)
    b1: np.ndarray
    w2: np.ndarray  # (HIDDEN,)
    b2: np.ndarray
    constant: float | None = None

    @staticmethod
    def fresh(rng: np.random.Generator) -> Network:
        draw = lambda *s, of=1.0: (rng.standard_normal(s) * of).astype(np.float32)
        return Network(
            draw(257, EMBEDDING, of=0.5), draw(WIDTH * EMBEDDING, FILTERS, of=(WIDTH * EMBEDDING) ** -0.5), np.zeros(FILTERS, np.float32),
            draw(2 * FILTERS, HIDDEN, of=(2 * FILTERS) ** -0.5), np.zeros(HIDDEN, np.float32), draw(HIDDEN, of=HIDDEN**-0.5), np.zeros(1, np.float32),
        )

    def params(self) -> list[np.ndarray]:
        return [self.emb, self.conv, self.bias, self.w1, self.b1, self.w2, self.b2]

    def pooled(self, chunks: np.ndarray, with_places: bool = False, sizes: np.ndarray | None = None):
        """Each filter's maximum over each chunk (rows of bytes; ``sizes``: without padding), and where it lies."""
        n, size = chunks.shape
        steps = (size - WIDTH) // STRIDE + 1
        x = self.emb[chunks].reshape(n, size // STRIDE, STRIDE * EMBEDDING)
        half = STRIDE * EMBEDDING
        act = (x.reshape(-1, half) @ self.conv[:half]).reshape(n, -1, FILTERS)[:, :steps]
        act = act + (x.reshape(-1, half) @ self.conv[half:]).reshape(n, -1, FILTERS)[:, 1 : steps + 1]
        if sizes is not None:
            windows = np.maximum(-(-sizes // STRIDE) - WIDTH // STRIDE, 0) + 1
            for i in np.flatnonzero(windows < steps):
                act[i, windows[i] :] = -np.inf
        if not with_places:
            return np.maximum(act.max(axis=1) + self.bias, 0)
        place = act.argmax(axis=1)
        return np.maximum(np.take_along_axis(act, place[:, None], 1)[:, 0] + self.bias, 0), place

    def combine(self, pooled: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Document features: maximum and mean over each document's chunks."""
        counts = np.diff(np.append(first, len(pooled)))[:, None]
        return np.concatenate([np.maximum.reduceat(pooled, first), np.add.reduceat(pooled, first) / counts], axis=1)

    def head(self, feats: np.ndarray) -> np.ndarray:
        hidden = np.tanh(feats @ self.w1 + self.b1)
        return 1 / (1 + np.exp(-np.clip(hidden @ self.w2 + self.b2, -30, 30)))

    def score(self, texts: list[bytes]) -> list[float]:
        if self.constant is not None:
            return [self.constant] * len(texts)
        if not texts:
            return []
        maxima, sums, counts = [], [], []
        for text in texts:
            total, most, n = np.zeros(FILTERS), np.zeros(FILTERS), 0
            cut = np.frombuffer(text, np.uint8)
            span = (CHUNK - OVERLAP) * SCORED_AT_ONCE
            for a in range(0, max(1, len(cut) - OVERLAP), span):
                part = cut[a : a + span + OVERLAP]
                got = self.pooled(chunked(part), sizes=sizes_of(len(part)))
                total, most, n = total + got.sum(axis=0), np.maximum(most, got.max(axis=0)), n + len(got)
            maxima.append(most)
            sums.append(total)
            counts.append(n)
        feats = np.concatenate([np.array(maxima), np.array(sums) / np.array(counts)[:, None]], axis=1)
        return self.head(feats).astype(float).tolist()


def chunked(text: np.ndarray) -> np.ndarray:
    """Overlapping chunks that cover ``text``; the last one, and no text, are padded.

    A text of one chunk is padded only to a multiple of STRIDE, WIDTH at least.
    """
    if len(text) <= CHUNK:
        size = max(WIDTH, -(-len(text) // STRIDE) * STRIDE)
        out = np.full((1, size), PAD, np.int16)
        out[0, : len(text)] = text
        return out
    step = CHUNK - OVERLAP
    n = 1 + -(-(len(text) - CHUNK) // step)
    padded = np.full((n - 1) * step + CHUNK, PAD, np.int16)
    padded[: len(text)] = text
    return np.lib.stride_tricks.sliding_window_view(padded, CHUNK)[::step]


def sizes_of(n: int) -> np.ndarray:
    """Bytes of a text of ``n`` bytes in each of its chunks."""
    step = CHUNK - OVERLAP
    return np.minimum(n - step * np.arange(1 + max(0, -(-(n - CHUNK) // step))), CHUNK)


def _blocks(texts: list[bytes]) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray]:
    """Chunks of CHUNK bytes each, and their sizes, in blocks; each text's first chunk."""
    chunks, sizes = [], [sizes_of(len(t)) for t in texts]
    for text in texts:
        own = chunked(np.frombuffer(text, np.uint8))
        chunks.append(np.pad(own, ((0, 0), (0, CHUNK - own.shape[1])), constant_values=PAD))
    first = np.cumsum([0, *map(len, chunks[:-1])])
    rows, size = np.concatenate(chunks), np.concatenate(sizes)
    return [(rows[a : a + SCORED_AT_ONCE], size[a : a + SCORED_AT_ONCE]) for a in range(0, len(rows), SCORED_AT_ONCE)], first


def train(texts: list[bytes], labels: list[int], passes: int = PASSES, seed: int = SEED) -> Network:
    """Adam on the cross entropy: ``passes`` over the sample, more if that makes few steps."""
    rng = np.random.default_rng(seed)
    net = Network.fresh(rng)
    y = np.array(labels, np.float32)
    if not len(y) or y.min() == y.max():
        net.constant = float(y.mean()) if len(y) else 0.5
        return net
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in net.params()]
    batches = -(-len(texts) // BATCH)
    passes = max(passes, -(-LEAST_STEPS // batches))
    t, last = 0, passes * batches
    for _ in range(passes):
        order = rng.permutation(len(texts))
        for a in range(0, len(order), BATCH):
            rows = order[a : a + BATCH]
            blocks, first = _blocks([texts[i] for i in rows])
            grads = _gradients(net, blocks, first, y[rows])
            t += 1
            rate = 0.004 * min(1, t / 20) * (0.02 + 0.98 * 0.5 * (1 + np.cos(np.pi * t / last)))
            for p, g, (m, v) in zip(net.params(), grads, moments, strict=True):
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                p -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    return net


def _gradients(net: Network, chunks: np.ndarray | list, first: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
    """Of the mean loss; ``chunks``: rows of bytes, or blocks of rows and their sizes."""
    blocks = chunks if isinstance(chunks, list) else [(chunks, None)]
    found = [net.pooled(rows, True, sizes) for rows, sizes in blocks]
    pooled, place = (np.concatenate(x) for x in zip(*found, strict=True))
    feats = net.combine(pooled, first)
    hidden = np.tanh(feats @ net.w1 + net.b1)
    p = 1 / (1 + np.exp(-np.clip(hidden @ net.w2 + net.b2, -30, 30)))
    d_logit = ((p - y) / len(y)).astype(np.float32)
    d_hidden = d_logit[:, None] * net.w2 * (1 - hidden**2)
    d_feats = d_hidden @ net.w1.T
    counts = np.diff(np.append(first, len(pooled)))
    doc = np.repeat(np.arange(len(first)), counts)
    top = pooled == feats[doc, :FILTERS]
    ties = np.add.reduceat(top.astype(np.float32), first)[doc]
    d_pooled = d_feats[doc, :FILTERS] * top / ties + d_feats[doc, FILTERS:] / counts[doc][:, None]
    d_pooled *= pooled > 0
    d_conv, d_emb, at = np.zeros_like(net.conv), np.zeros_like(net.emb), 0
    for rows, _ in blocks:  # Only the places of the maxima get a gradient.
        start, d = place[at : at + len(rows)] * STRIDE, d_pooled[at : at + len(rows)]
        at += len(rows)
        seen = rows[np.arange(len(rows))[:, None, None], start[:, :, None] + np.arange(WIDTH)]  # chunk, filter, byte
        x = net.emb[seen].reshape(len(rows), FILTERS, -1)
        d_conv += np.einsum("nfk,nf->kf", x, d, optimize=True)
        d_x = (d[:, :, None] * net.conv.T[None]).reshape(-1, EMBEDDING)
        flat = seen.reshape(-1)
        d_emb += np.stack([np.bincount(flat, d_x[:, e], 257) for e in range(EMBEDDING)], axis=1).astype(net.emb.dtype)
    return [d_emb, d_conv, d_pooled.sum(axis=0), feats.T @ d_hidden, d_hidden.sum(axis=0), hidden.T @ d_logit, d_logit.sum(keepdims=True)]


def held_out(id_col: str = "doc_id"):
    """Rows that are never learned from; a null id is held out."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(4)) == 2, F.lit(True))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample_rows: int = SAMPLE_ROWS) -> Network:
    """Train on at most ``sample_rows`` labelled rows that aren't held out, and about ``SAMPLE_BYTES``."""
    usable = labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(id_col))
    sample = usable.select(F.col(id_col).alias("i"), F.col(label_col).cast("int").alias("y")).orderBy(F.xxhash64("i"), "i", "y").limit(sample_rows)
    texts = docs.select(F.col(id_col).alias("i"), F.coalesce(F.col(text_col), F.lit("")).alias("body"))
    order = (F.xxhash64("i"), "i", "y", "body")
    before = F.sum(F.octet_length("body").cast("long")).over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    first = texts.join(F.broadcast(sample), "i").orderBy(*order).limit(sample_rows)
    rows = first.withColumn("before", F.coalesce(before, F.lit(0))).filter(F.col("before") < SAMPLE_BYTES).select("body", "y")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bodies, labels = [], []
        for batch in batches:
            bodies += batch.column(0).cast(pa.binary()).to_pylist()
            labels += batch.column(1).to_pylist()
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(train(bodies, labels))], pa.binary())], names=["net"])

    bound_batches(docs.sparkSession)
    made = rows.mapInArrow(run, "net binary").collect()  # the sample is one partition, in order
    return pickle.loads(made[0].net) if made else train([], [])


def classify(docs: DataFrame, net: Network, text_col: str = "text", out: str = "judged") -> DataFrame:
    """``docs`` with the struct ``out``: ``score``, the probability of label 1."""
    kind = T.StructType([T.StructField("score", T.DoubleType())])
    return with_struct(docs, text_col, out, kind, lambda: lambda texts: {"score": net.score(texts)})
