import random
import re
import sys
import zlib

import numpy as np
import public_tokenizers as P
import pytest
from strata.llm import packing, token_files
from strata.llm import tokens as K
from tokenizers import Tokenizer

PATH = P.path("word_bpe_49k.json")
DEFINITION = open(PATH, encoding="utf-8").read()
TEXTS = [
    None, "", " ", "Hello  World\n\nit's we'll 1234 ABC's", "a\x1cb a\x85b a b c", "é é ́x", "İstanbul ΣΣ σς",
    "<|endoftext|> x<|startoftext|>y <|endoftext|", "\U0001f600\U0001f468‍\U0001f469 日本語", "\x00\x0b\x0c\r﻿", "x" * 300, "ab " * 5000, "isn't ''s 're'S it'LL x'd9've don't!'s", "ÀÉÎ ß ÿŸ µm ªº ×÷ naïve", "a_b-c/d 3.14 \x1f~",
]


def whole(texts):
    t = Tokenizer.from_file(PATH)
    return [np.array([*t.encode(x or "", add_special_tokens=False).ids, 1], "<u4") for x in texts]


def test_words_one_by_one_give_the_librarys_ids():
    rng = random.Random(1)
    pool = [c for t in TEXTS if t for c in t[:60]]
    texts = [t or "" for t in TEXTS] + ["".join(rng.choice(pool) for _ in range(200)) for _ in range(300)]
    encoder = K.Encoder(DEFINITION, True)
    for _ in range(2):  # with and without a filled cache
        got = encoder.packed([t.encode() for t in texts])
        assert [np.frombuffer(g, "<u4").tolist() for g in got] == [w[:-1].tolist() for w in whole(texts)]


def test_cache_is_bounded_and_keeps_what_is_used(monkeypatch):
    monkeypatch.setattr(K, "CACHED", 50)
    encoder = K.Encoder(DEFINITION, True)
    for k in range(20):
        text = "often " + " ".join(f"W{k}x{i}." for i in range(30)) + " " + "y" * 100
        assert np.frombuffer(encoder.packed([text.encode()])[0], "<u4").tolist() == whole([text])[0][:-1].tolist()
        for cache in (encoder.words, encoder.pieces):
            assert len(cache.young) + len(cache.old) <= 2 * (50 + 70)
    assert b"often" in encoder.words.young and b"y" * 100 not in encoder.words.young


@pytest.mark.parametrize("n", [1, 2, 255, 256, 257, 1500])
def test_elias_fano_round_trip_and_select(n):
    rng = np.random.default_rng(n)
    for high in (1, 3, 500, 40_000):
        ends = np.cumsum(rng.integers(0, high, n))
        ids = rng.integers(0, 49408, ends[-1])
        back, code = token_files.read_segment(token_files.write_segment(ids, ends, 2))
        assert (back == ids).all() and [code.select(i) for i in range(code.n)] == ends.tolist()


def test_boundaries_take_little_space():
    ends = np.cumsum(np.random.default_rng(0).integers(50, 2000, 5000))
    code = token_files.EliasFano.encode(ends)
    assert 8 * (code.low.nbytes + code.high.nbytes + code.samples.nbytes) / 5000 < np.log2(ends[-1] / 5000) + 2.6


def frame(spark, rows):
    return spark.createDataFrame([(i, t, i, "x") for i, t in rows], "doc_id long, text string, part long, DATA string")


def test_files_hold_all_documents_in_order(spark):
    rows = [(7 * k % 100 - 20, t) for k, t in enumerate(TEXTS)] + [(3, "b"), (3, "a"), (None, "first")]
    got = token_files.read_tokens(token_files.write_tokens(frame(spark, rows), DEFINITION, 1, by_words=True, segment_ids=100)).collect()
    ordered = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    at, want = 0, []
    for (i, _), ids in zip(ordered, whole([t for _, t in ordered]), strict=True):
        want.append((i, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert sorted(map(tuple, got), key=lambda r: r[1]) == want


def test_no_documents(spark):
    none = frame(spark, [])
    assert token_files.read_tokens(token_files.write_tokens(none, DEFINITION, 1, by_words=True)).count() == 0
    assert packing.pack(none, DEFINITION, 1, by_words=True).count() == 0


def check_packing(got, capacity):
    by = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in by.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


def test_packing_keeps_every_token(spark):
    rng = random.Random(6)
    rows = [(k, " ".join(["ab"] * rng.choice([0, 3, 10, 17, 30, 64, 200]))) for k in range(400)] + [(5, "ab"), (None, None)]
    got = packing.pack(frame(spark, rows).repartition(5), DEFINITION, 1, 32, by_words=True).collect()
    check_packing(got, 32)
    found = {}
    for r in got:
        assert len(r.ids) == 2 * r.length and zlib.crc32(np.frombuffer(r.ids, "<u2").astype("<u4").tobytes()) == r.ids_crc32
        found.setdefault(r.doc_id, []).append((r.piece, r.start, r.length))
    for (i, _), ids in zip(rows, whole([t for _, t in rows]), strict=True):
        cuts = [(k, at, min(32, len(ids) - at)) for k, at in enumerate(range(0, len(ids), 32))]
        assert all(c in found[i] for c in cuts)
    assert len(got) == sum(-(-len(w) // 32) for w in whole([t for _, t in rows]))


def item_by_item(sizes, capacity):
    """The same rules, one piece at a time."""
    large = sorted((s for s in sizes if 3 * s > capacity), reverse=True)
    bins = []
    while large:
        s = large.pop(0)
        fits = [x for x in large if s + x <= capacity]
        if fits:
            large.remove(max(fits))
        bins.append(s + max(fits, default=0))
    for s in sorted((s for s in sizes if 3 * s <= capacity), reverse=True):
        fits = [b for b in range(len(bins)) if bins[b] + s <= capacity]
        if fits:
            bins[max(fits, key=lambda b: bins[b])] += s
        else:
            bins.append(s)
    return sorted(bins)


def test_plan_equals_the_rules_item_by_item():
    rng = random.Random(9)
    for _ in range(200):
        capacity = rng.choice([7, 30, 100])
        sizes = [rng.randint(1, capacity) if rng.random() < 0.6 else rng.choice([1, 2, capacity // 2, capacity // 3]) for _ in range(rng.randint(0, 150))]
        counts = {}
        for s in sizes:
            counts[s] = counts.get(s, 0) + 1
        classes = packing.plan(counts, capacity)
        bins = sorted(capacity - gap for times, gap, _ in classes for _ in range(times))
        assert bins == item_by_item(sizes, capacity)
        used = {}
        for times, gap, content in classes:
            assert gap + sum(s * n for s, n in content) == capacity
            for s, n in content:
                used[s] = used.get(s, 0) + times * n
        assert used == counts


def test_plan_of_a_huge_histogram_is_fast():
    counts = {s: 10**9 // s for s in range(1, 4097)}
    classes = packing.plan(counts, 4096)
    total = sum(s * n for s, n in counts.items())
    assert sum(t for t, _, _ in classes) <= 1.01 * total / 4096
    assert sum(len(r) for r in packing.slots(classes).values()) < 500_000


def test_pieces_are_those_of_their_rule():
    simple, rule = re.compile(r"[\x00-\x7FÀ-ÖØ-öø-ÿ]+"), re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^0-9a-zß-öø-ÿ]+")
    rng = random.Random(3)
    signs = "abrevlstmdSTÀÖØßöøÿÞ''''05-_\x00\x1c\x7f×÷éİ日\U0001f600"
    words = ["".join(rng.choice(signs) for _ in range(rng.randint(1, 9))) for _ in range(20_000)]
    held = K.is_simple([w.encode() for w in words]).tolist()
    assert held == [bool(simple.fullmatch(w)) for w in words]
    words = [w for w, h in zip(words, held, strict=True) if h]
    pieces, counts = K.split_pieces([w.encode() for w in words])
    want = [rule.findall(w.lower()) for w in words]
    assert [p.decode() for p in pieces.to_pylist()] == sum(want, []) and counts.tolist() == [len(x) for x in want]


def test_ids_are_put_together_in_order():
    blobs = [np.array(x, "<u4").tobytes() for x in ([5], [], [7, 8, 9])]
    got = K.put_together(blobs, np.array([2, 0, 1, 2]), np.array([0, 2, 0, 2, 0]))
    assert [np.frombuffer(g, "<u4").tolist() for g in got] == [[], [7, 8, 9, 5], [], [7, 8, 9], []]
    assert K.put_together([], np.zeros(0, np.int64), np.array([0, 0])) == [b"", b""] and K.put_together([], np.zeros(0, np.int64), np.array([], np.int64)) == []


def test_new_words_of_known_pieces_take_few_calls():
    encoder = K.Encoder(DEFINITION, True)
    parts = [a + b for a in "abcdefghij" for b in "klmnopqrst"]
    encoder.packed([" ".join(parts).encode() + b" -"])
    text = " ".join(f"{a}-{b}" for a in parts for b in parts[:50]).encode()
    n = 0

    def count(frame, event, arg):
        nonlocal n
        n += event in ("call", "c_call")

    before = sys.getprofile()
    sys.setprofile(count)
    try:
        [got] = encoder.packed([text])
    finally:
        sys.setprofile(before)
    assert n < 3 * 5000
    assert np.frombuffer(got, "<u4").tolist() == whole([text.decode()])[0][:-1].tolist()
