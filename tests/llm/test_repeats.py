import random

import numpy as np
import pytest
from strata.llm import repeats as R


def brute(docs, length):
    """docs in order: (id, bytes). Removed bytes, spans, kept bytes."""
    seen, out = set(), []
    for i, text in docs:
        gone = bytearray(len(text))
        for s in range(len(text) - length + 1):
            string = text[s : s + length]
            if string in seen:
                gone[s : s + length] = b"\1" * length
            seen.add(string)
        spans = sum(gone[k] and not (k and gone[k - 1]) for k in range(len(gone)))
        out.append((i, len(text), sum(gone), spans, bytes(c for c, g in zip(text, gone, strict=True) if not g)))
    return out


def edited(rng, text, n):
    text = list(text)
    for _ in range(n):
        if text:
            k = rng.randrange(len(text))
            text[k : k + rng.choice([0, 1])] = rng.choice(["", "x", "yé"])
    return "".join(text)


def random_texts(seed):
    rng = random.Random(seed)
    letters = rng.choice(["ab", "abcdefgh ", "aé日 "])
    make = lambda n: "".join(rng.choice(letters) for _ in range(n))
    passage, texts = make(150), [None, "", "short"]
    while len(texts) < 70:
        kind = rng.random()
        if kind < 0.3:
            texts.append(make(rng.choice([10, 200, 600])))
        elif kind < 0.5:
            texts.append(rng.choice(texts))
        elif kind < 0.75:
            texts.append(edited(rng, rng.choice(texts) or "", rng.choice([1, 3, 8])))
        elif kind < 0.9:
            texts.append(make(rng.choice([0, 30])) + passage[rng.randint(0, 40) :] + make(rng.choice([0, 50])))
        else:
            texts.append(make(rng.choice([1, 3, 7, 30])) * rng.choice([10, 40]) + make(20))
    return texts


@pytest.mark.parametrize("seed", range(6))
def test_equals_brute_force(spark, seed):
    length = [24, 40, 100][seed % 3]
    texts = random_texts(seed)
    ids = random.Random(seed).sample(range(-50, 500), len(texts) - 1) + [None]
    df = spark.createDataFrame([(i, t, "x", b"") for i, t in zip(ids, texts, strict=True)], "doc_id long, text string, bucket string, kept binary").repartition(3)
    small = dict(chunk_bytes=2000, bytes_per_bucket=4000, segments_per_bucket=2000) if seed % 2 else {}
    got = [(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in R.find_repeats(df, length=length, **small).collect()]
    order = sorted(zip(ids, texts, strict=True), key=lambda x: (x[0] is not None, x[0] or 0))
    want = brute([(i, (t or "").encode()) for i, t in order], length)
    assert sorted(got, key=str) == sorted(want, key=str)


def test_equal_ids_are_documents_of_their_own(spark):
    rng = random.Random(1)
    text = "".join(rng.choice("abcdef") for _ in range(130))
    df = spark.createDataFrame([(7, text), (7, text), (7, text), (None, text)], "doc_id long, text string").coalesce(1)
    assert sorted((str(r.doc_id), r.n_removed, r.n_spans) for r in R.find_repeats(df).collect()) == [("7", 130, 1)] * 3 + [("None", 0, 0)]


def test_no_rows(spark):
    assert R.find_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@pytest.mark.parametrize("indexed", [200, 1 << 20])
def test_index_finds_strings_of_earlier_segments(indexed):
    rng = random.Random(5)
    base = bytes(rng.choice(b"abcd") for _ in range(400))
    segments, rank, group = [], [], []
    for g in range(6):
        for r in range(rng.choice([1, 2, 3, 9])):
            for _ in range(rng.choice([1, 2])):
                a = rng.randrange(300)
                segments.append(edited(rng, base[a : a + rng.choice([20, 100, 350])].decode(), rng.choice([0, 2])).encode())
                rank.append(r)
                group.append(g)
    got = R.repeats_among(segments, np.array(rank), np.array(group), 20, indexed)
    for i, s in enumerate(segments):
        earlier = [segments[k] for k in range(len(segments)) if group[k] == group[i] and rank[k] < rank[i]]
        assert got[i].tolist() == [x for x in range(len(s) - 19) if any(s[x : x + 20] in e for e in earlier)]


def test_index_keeps_runs_only():
    rng = np.random.default_rng(1)
    base = rng.integers(97, 101, 2000).astype(np.uint8).tobytes()
    index = R.Index([base] * 20, [0] * 20)
    assert len(index.starts) < 2500 < len(index.eights) / 10
    assert len(index.first) == len(index.last) == len(index.starts)


def test_suffix_array_is_sorted():
    rng = np.random.default_rng(2)
    segments = [bytes(rng.integers(97, 99, n).astype(np.uint8)) for n in (0, 5, 40, 40, 1)] + [b"ab" * 30] * 2
    plain = np.concatenate([np.append(np.frombuffer(s, np.uint8).astype(np.int64) + 1, 0) for s in segments])
    sizes = np.array([len(s) + 1 for s in segments])
    stops = np.cumsum(sizes) - 1
    tag = np.repeat(np.array([0, 1, 0, 1, 2, 0, 0]), sizes)
    order = R.suffix_array(plain, tag, np.repeat(stops, sizes))
    stop = np.repeat(stops, sizes)
    keys = [(tag[i] + 1 if i != stop[i] else 0, plain[i : stop[i]].tolist(), i) for i in order]
    assert sorted(order.tolist()) == list(range(len(plain)))
    assert keys == sorted(keys)
