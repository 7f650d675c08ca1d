import zlib

import numpy as np
from strata.llm import classifier as C


def test_chunks_cover_every_byte():
    for n in (0, 1, 7, 8, 1023, 1024, 1025, 5000, 12345):
        text = np.random.default_rng(n).integers(0, 256, n).astype(np.uint8)
        got = C.chunked(text)
        step = C.CHUNK - C.OVERLAP
        seen = np.full(max(n, 1), -1)
        for k, row in enumerate(got):
            part = seen[k * step : k * step + len(row)]
            part[:] = row[: len(part)]
        assert (seen[:n] == text).all()
        assert C.OVERLAP >= C.WIDTH


def test_gradients_equal_differences():
    rng = np.random.default_rng(0)
    net = C.Network.fresh(rng)
    for name in ("emb", "conv", "bias", "w1", "b1", "w2", "b2"):
        setattr(net, name, getattr(net, name).astype(np.float64))
    chunks = rng.integers(0, 257, (5, 64)).astype(np.int16)
    first, y = np.array([0, 2, 3]), np.array([1, 0, 1], np.float32)

    def loss():
        p = net.head(net.combine(net.pooled(chunks), first))
        return -np.mean(y * np.log(p) + (1 - y) * np.log(1 - p))

    for p, g in zip(net.params(), C._gradients(net, chunks, first, y), strict=True):
        for _ in range(6):
            at = tuple(rng.integers(0, s) for s in p.shape)
            old = p[at]
            p[at] = old + 1e-5
            up = loss()
            p[at] = old - 1e-5
            down = loss()
            p[at] = old
            assert abs((up - down) / 2e-5 - g[at]) < 1e-4


def corpus(n):
    rng = np.random.default_rng(4)
    words = ["river", "stone", "walks", "under", "green", "light", "often"]
    good = lambda: " ".join(rng.choice(words) for _ in range(rng.integers(5, 900)))
    bad = lambda: " ".join(rng.choice(words) + "$$%" for _ in range(rng.integers(5, 200)))
    return [(i, (bad if i % 5 == 0 else good)(), int(i % 5 != 0)) for i in range(n)]


def test_learns_and_never_sees_held_out_rows(spark):
    rows = corpus(300)
    docs = spark.createDataFrame([(i, t, "x", i) for i, t, _ in rows] + [(None, None, "x", 0), (1000, "", "x", 0)], "doc_id long, text string, judged string, quality long")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(None, 1), (1000, None)], "doc_id long, quality int")
    held = {r.doc_id for r in docs.filter(C.held_out()).collect()}
    assert held - {None} == {i for i in [*range(300), 1000] if zlib.crc32(str(i).encode()) % 4 == 2}
    net = C.fit(docs, labels)
    lied = labels.filter(~C.held_out()).unionByName(labels.filter(C.held_out()).selectExpr("doc_id", "1 - quality AS quality"))
    assert all((a == b).all() for a, b in zip(net.params(), C.fit(docs, lied).params(), strict=True))
    got = {r.doc_id: r.judged.score for r in C.classify(docs, net).collect()}
    assert len(got) == 302 and all(0 <= s <= 1 for s in got.values())
    right = [(got[i] >= 0.7) == bool(y) for i, _, y in rows if i in held]
    assert np.mean(right) > 0.95


def test_score_of_a_text_does_not_depend_on_its_batch():
    net = C.train([t.encode() for _, t, _ in corpus(60)], [y for *_, y in corpus(60)], passes=1)
    texts = [t.encode() for _, t, _ in corpus(40)] + [b"", b"x" * 700_000]
    assert np.allclose(net.score(texts), [net.score([t])[0] for t in texts])


def test_without_usable_labels(spark):
    docs = spark.createDataFrame([(1, "a"), (2, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert [r.judged.score for r in C.classify(docs, C.fit(docs, none)).collect()] == [0.5, 0.5]
    assert C.classify(docs.limit(0), C.fit(docs, none)).count() == 0


def test_training_pools_what_scoring_pools():
    rng = np.random.default_rng(9)
    net = C.Network.fresh(rng)
    net.emb[C.PAD] = 50.0
    net.bias += 0.1
    texts = [rng.integers(97, 123, n).astype(np.uint8).tobytes() for n in (0, 1, 9, 700, 1023, 1024, 1025, 1900, 2000, 9000, 270_000)]
    blocks, first = C._blocks(texts)
    feats = net.combine(np.concatenate([net.pooled(rows, sizes=sizes) for rows, sizes in blocks]), first)
    assert np.allclose(net.head(feats), net.score(texts), atol=1e-5)
    # Windows of padding alone are nowhere pooled: a text and its longer copy of the same bytes agree.
    same = [b"abcd" * n for n in (4, 255, 256, 257, 300, 2000)]
    assert np.ptp(net.score(same)) < 1e-6


def plain_score(net, text):
    """The network in plain loops over one text."""
    step, chunks = C.CHUNK - C.OVERLAP, []
    at = 0
    while True:
        chunks.append(text[at : at + C.CHUNK])
        if at + C.CHUNK >= len(text):
            break
        at += step
    pooled = []
    for chunk in chunks:
        windows = max(-(-len(chunk) // C.STRIDE) - C.WIDTH // C.STRIDE, 0) + 1
        padded = list(chunk) + [C.PAD] * (C.WIDTH + C.STRIDE)
        best = [0.0] * C.FILTERS
        for w in range(windows):
            x = [float(v) for b in padded[w * C.STRIDE : w * C.STRIDE + C.WIDTH] for v in net.emb[b]]
            for f in range(C.FILTERS):
                best[f] = max(best[f], sum(a * float(k) for a, k in zip(x, net.conv[:, f], strict=True)) + float(net.bias[f]))
        pooled.append(best)
    feats = [max(c[f] for c in pooled) for f in range(C.FILTERS)] + [sum(c[f] for c in pooled) / len(pooled) for f in range(C.FILTERS)]
    hidden = [np.tanh(sum(x * float(w) for x, w in zip(feats, net.w1[:, h], strict=True)) + float(net.b1[h])) for h in range(C.HIDDEN)]
    return 1 / (1 + np.exp(-(sum(h * float(w) for h, w in zip(hidden, net.w2, strict=True)) + float(net.b2[0]))))


def test_scores_equal_a_plain_convolution():
    rng = np.random.default_rng(3)
    net = C.Network.fresh(rng)
    net.bias += rng.standard_normal(C.FILTERS).astype(np.float32) * 0.2
    texts = [b"", b"a", "é1234567".encode(), bytes(range(97, 123)) * 3, bytes(rng.integers(32, 127, 1023).astype(np.uint8)), bytes(rng.integers(32, 127, 1100).astype(np.uint8))]
    assert np.allclose(net.score(texts), [plain_score(net, t) for t in texts], atol=1e-4)
