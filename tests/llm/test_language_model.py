import collections
import math
import random
import re
import sys
import zlib

import numpy as np
from strata.llm import blobs
from strata.llm import language_model as L
from strata.llm import pitman_yor as P

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def corpus(n, seed=1):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(60)]
    after = {w: rng.sample(words, 3) for w in words}
    docs = []
    for i in range(n):
        w = rng.choice(words)
        text = [w]
        for _ in range(rng.choice([0, 5, 60])):
            w = rng.choice(after.get(w, words)) if rng.random() < 0.8 else rng.choice([*words, f"rare{rng.randint(0, 500)}", "THE"])
            text.append(w)
        docs.append((i, rng.choice([" ", "\n"]).join(text)))
    return docs


def base(docs):
    lower = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    tokens = [[*WORD.findall(lower(t)), None] for _, t in docs]
    held = [i is not None and zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in docs]
    counts = collections.Counter(w for own, h in zip(tokens, held, strict=True) if not h for w in own)
    n, v = sum(counts.values()), len(counts)
    return [
        (i, h, len(own), sum(counts[w] > 0 for w in own), n, sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in own))
        for (i, _), own, h in zip(docs, tokens, held, strict=True)
    ]


def check_base(got, docs):
    key = lambda r: tuple(str(x) for x in r[:4])
    got = sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in got), key=key)
    for a, b in zip(got, sorted(base(docs), key=key), strict=True):
        assert a[:5] == b[:5] and math.isclose(a[5], b[5], rel_tol=1e-9)


def test_base_and_held_out_gain_at_any_number_of_buckets(spark):
    docs = corpus(400) + [(1000, None), (None, "w1 w2 w3"), (1000, ""), (7, "é É x w1 " * 80), (7, "é É x w1 " * 80)]
    df = spark.createDataFrame([(i, t, 0.0) for i, t in docs], "doc_id long, text string, score double").repartition(3)
    means = []
    for size in (10**9, 500):
        got = L.score_texts(df, tokens_per_bucket=size, chunk_bytes=3000, common_from=20).collect()
        check_base(got, docs)
        held = [r for r in got if r.held_out]
        assert sum(r.score for r in held) > sum(r.base_score for r in held) * 0.9
        means.append(sum(r.score for r in held))
    assert abs(means[0] / means[1] - 1) < 0.02


def naive(docs, sweeps=30, burn=10, seed=1):
    """One-process sampler, customer by customer with its table sizes; the score of each text.

    Discounts are estimated as the operator does; strengths are the operator's.
    """
    rng = random.Random(seed)
    lower = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    texts = [[*WORD.findall(lower(t)), None] for _, t in docs]
    pairs = [list(zip([None, *own[:-1]], own, strict=True)) for own in texts]
    held = [i is not None and zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in docs]
    tokens = [p for own, h in zip(pairs, held, strict=True) if not h for p in own]
    counts = collections.Counter(tokens)
    of = lambda c: P.discount_of(sum(x == 1 for x in c.values()), sum(x == 2 for x in c.values()))
    d, root_d = of(counts), of(collections.Counter(w for _, w in counts))
    base = 1 / (len({w for _, w in tokens}) + 1)
    tables, of_context, customers = collections.defaultdict(list), collections.Counter(), collections.Counter(u for u, _ in tokens)
    seated = collections.Counter()
    root, totals = collections.defaultdict(list), [0, 0]  # customers and tables of the parent

    def parent(w):
        return (sum(root[w]) - root_d * len(root[w]) + (L.ROOT_STRENGTH + root_d * totals[1]) * base) / (L.ROOT_STRENGTH + totals[0])

    def enter_root(w, sign):
        own = root[w]
        if sign < 0:
            k = rng.choices(range(len(own)), own)[0]
            own[k] -= 1
            totals[0] -= 1
            if not own[k]:
                own.pop(k)
                totals[1] -= 1
            return
        weights = [n - root_d for n in own] + [(L.ROOT_STRENGTH + root_d * totals[1]) * base]
        k = rng.choices(range(len(weights)), weights)[0]
        totals[0] += 1
        if k == len(own):
            own.append(1)
            totals[1] += 1
        else:
            own[k] += 1

    def sit(u, w):
        own = tables[u, w]
        k = rng.choices(range(len(own) + 1), [n - d for n in own] + [(L.STRENGTH + d * of_context[u]) * parent(w)])[0]
        if k == len(own):
            own.append(1)
            of_context[u] += 1
            enter_root(w, 1)
        else:
            own[k] += 1

    def leave(u, w):
        own = tables[u, w]
        k = rng.choices(range(len(own)), own)[0]
        own[k] -= 1
        if not own[k]:
            own.pop(k)
            of_context[u] -= 1
            enter_root(w, -1)

    for u, w in tokens:
        sit(u, w)
    total = collections.Counter()
    for sweep in range(sweeps):
        for u, w in tokens:
            leave(u, w)
            sit(u, w)
        if sweep >= burn:
            for u, w in {p for own in pairs for p in own}:
                own = tables.get((u, w), [])
                total[u, w] += (sum(own) - d * len(own) + (L.STRENGTH + d * of_context[u]) * parent(w)) / (L.STRENGTH + customers[u])
    return [sum(math.log10(total[p] / (sweeps - burn)) for p in own) for own in pairs]


def test_scores_equal_those_of_a_naive_sampler(spark):
    docs = corpus(150)
    want = naive(docs)
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    for size in (10**9, 700):  # one bucket, and several
        got = {r.doc_id: r for r in L.score_texts(df, tokens_per_bucket=size, chunk_bytes=3000, common_from=20).collect()}
        for held in (True, False):
            ours, theirs = (np.array([x for (i, _), x in zip(docs, s, strict=True) if got[i].held_out == held]) for s in ([got[i].score for i, _ in docs], want))
            assert abs(ours.sum() / theirs.sum() - 1) < 0.01 and np.abs(ours - theirs).max() < 0.03 * np.abs(theirs).max()


def test_a_sample_adds_up_to_one():
    rng = np.random.default_rng(1)
    words, contexts = 30, 6
    c = rng.integers(0, 5, (contexts, words))
    context, word = (x.ravel() for x in np.indices(c.shape))
    t = np.minimum(c.ravel(), rng.integers(1, 3, c.size))
    k = np.bincount(word, t, words)
    root = np.minimum(k, 2)
    parent = L.Parent((k > 0).sum(), k.sum(), root.sum(), 0.4)
    p0 = parent.of(k, root)
    assert math.isclose(p0[k > 0].sum() + parent.of(0, 0), 1, rel_tol=1e-12)
    n = contexts + words
    customers, tables = np.bincount(context, c.ravel(), n), np.bincount(context, t, n)
    p = L.predictive(c.ravel(), t, context, customers, tables, p0[word], 0.7).reshape(c.shape)
    unknown = L.predictive(np.zeros(contexts), np.zeros(contexts), np.arange(contexts), customers, tables, np.full(contexts, parent.of(0, 0)), 0.7)
    assert np.allclose(p[:, k > 0].sum(axis=1) + unknown, 1, rtol=1e-12)


def brute_tables(c, others, a, b, d, strength):
    """Weights of t tables, through the recursion of Stirling numbers in plain floats."""
    s = [[0.0] * (c + 1) for _ in range(c + 1)]
    s[0][0] = 1.0
    for n in range(c):
        for t in range(n + 2):
            s[n + 1][t] = s[n][t] * (n - d * t) + (s[n][t - 1] if t else 0)
    w = [0.0] + [s[c][t] * math.prod((strength + d * (others + i)) * (a + i) / (b + i) for i in range(1, t)) for t in range(1, c + 1)]
    return [x / sum(w) for x in w]


CASES = ((2, 0, 0.5, 1.0, 0.5), (3, 0, 0.2, 5.0, 0.6), (12, 3, 2.3, 9.0, 0.3), (48, 40, 0.5, 100.0, 0.6), (48, 1000, 30.0, 400.0, 0.8), (48, 5, 0.001 * 1e18, 1e18, 0.5))


def test_tables_follow_their_conditional_distribution():
    rng = np.random.default_rng(3)
    n = 20_000
    full = lambda x: np.full(n, float(x))
    for c, others, a, b, d in CASES:
        want = brute_tables(c, others, a, b, d, 1.0)
        for exact in (P.EXACT, 2):  # drawn from the weights, and in jumps
            t = P.seat(np.full(n, c), full(others), full(a), full(b), d, 1.0, rng, exact)
            assert np.abs(np.bincount(t, minlength=c + 1) / n - want).max() < (0.015 if exact > 2 else 0.03)
            assert abs(t.mean() / np.dot(want, np.arange(c + 1)) - 1) < (0.015 if exact > 2 else 0.03)


def test_log_gamma():
    x = np.array([0.03, 0.5, 1, 2.5, 10, 1e3, 1e7])
    assert np.allclose(P.log_gamma(x), [math.lgamma(v) for v in x], rtol=1e-12, atol=1e-9)


def test_pack_round_trip():
    arrays = [np.array([], np.int64), np.array([1, 300, 2**40]), np.array([-1, 5]), np.array([0.5, np.inf]), np.array([True, False]), np.array([0, 2**64 - 1], np.uint64)]
    for a, b in zip(arrays, blobs.unpack(blobs.pack(*arrays)), strict=True):
        assert (a == b).all() and len(a) == len(b)


def test_empty_and_untrained(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert L.score_texts(df).count() == 0
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2)
    [r] = L.score_texts(spark.createDataFrame([(held, "a b")], "doc_id long, text string")).collect()
    assert (r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) == (3, 0, 0, 0.0, 0.0)


def test_thin_hashes_round_trip():
    rng = np.random.default_rng(5)
    for n in (0, 1, 2, 1000):
        h = np.unique(np.concatenate([rng.integers(0, 2**63, n).astype(np.uint64) * np.uint64(2), np.zeros(min(n, 1), np.uint64)]))
        assert (blobs.thick(blobs.thin(h)) == h).all()


def test_a_common_word_is_spread():
    rng = np.random.default_rng(6)
    words, one = rng.integers(0, 2**63, 100_000).astype(np.uint64), np.full(100_000, 7, np.uint64)
    for buckets in (1, 20, 1000):
        for pair in ((one, words), (words, one)):
            n = np.bincount(L.bucket_of(*pair, buckets), minlength=buckets)
            assert len(n) == buckets and n.max() <= max(100_000 / buckets, 5 * 100_000 / np.sqrt(buckets) / 2)
        n = np.bincount(L.bucket_of(words, words[::-1], buckets), minlength=buckets)
        assert n.max() <= 5 * 100_000 / buckets


def test_words_are_split_by_their_rule():
    texts = ["", " ", "a", " A\x1cb\x85 \tÉé\x0b\x0c\r\nZ ", "x\u2003y\u00a0z", "\x00 \x1f", "end "]
    words, n = L.split_words([t.encode() for t in texts])
    want = [WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)) for t in texts]
    assert [w.decode() for w in words.to_pylist()] == sum(want, []) and n.tolist() == [len(w) for w in want]
    for texts in ([b""], [b"", b" "], [b"a"]):
        words, n = L.split_words(texts)
        assert len(words) == n.sum() and len(n) == len(texts)


def test_sorted_places_with_and_without_room_for_them():
    rng = np.random.default_rng(8)
    for n in (0, 1, 2, 1000):
        for most in (1, 7, 1 << 40, 1 << 62):
            keys = rng.integers(0, most, n)
            got, places = L.sort_places(keys, most)
            assert (places == np.argsort(keys, kind="stable")).all() and (got == keys[places]).all()


def test_a_chunk_handles_distinct_words_one_by_one_but_not_their_repeats():
    def calls(texts):
        n = 0

        def count(frame, event, arg):
            nonlocal n
            n += event in ("call", "c_call")

        before = sys.getprofile()
        sys.setprofile(count)
        try:
            blobs_ = list(L.Chunk(texts, np.ones(len(texts), bool)).sent(3, True))
        finally:
            sys.setprofile(before)
        assert blobs_
        return n

    text = " ".join(f"w{i * i % 97}" for i in range(500)).encode()
    L.Chunk([text], np.ones(1, bool))
    assert calls([text] * 100) < 1.5 * calls([text])


def test_both_ways_to_weigh_tables_agree():
    rng = np.random.default_rng(9)
    b = rng.random(50) * 1e6 + 1
    for n in (2, 3, 16):
        ways, others, a = P.log_stirling(0.6, 256)[n, 1 : n + 1], rng.integers(0, 10**6, 50), b * rng.random(50)
        one, other = (f(ways, others, a, b, 0.6, 1.0) for f in (P._by_products, P._by_logarithms))
        assert np.allclose(one / one[-1], other / other[-1], rtol=1e-9)
    # Products stay finite, whatever a corpus may hold.
    far = P._by_products(P.log_stirling(0.95, 256)[P.PRODUCTS, 1 : P.PRODUCTS + 1], np.array([1e12, 0.0]), np.array([1e12, 1e-12]), np.array([1e12, 1e12]), 0.95, 1.0)
    assert np.isfinite(far).all() and (far[-1] > 0).all()
