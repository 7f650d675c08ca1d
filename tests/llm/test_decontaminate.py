import random
import re

import numpy as np
from strata.llm import decontaminate as D

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def brute(docs, items, window=10):
    windows = {}
    for item, text in items:
        w = WORD.findall(lower(text))
        n = min(window, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            windows.setdefault(tuple(w[i : i + n]), set()).add("" if item is None else str(item))
    out = []
    for doc, text in docs:
        w = WORD.findall(lower(text))
        hit, found = set(), set()
        for n in range(1, window + 1):
            for i in range(len(w) - n + 1):
                if own := windows.get(tuple(w[i : i + n])):
                    hit.update(range(i, i + n))
                    found |= own
        out.append((doc, len(w), len(hit), sorted(found)))
    return out


def random_case(seed):
    rng = random.Random(seed)
    vocab = ["a", "b", "Für", "été", "x1", "THE", "of", "日本"]
    text = lambda n: "".join(rng.choice(vocab) + rng.choice([" ", ", ", "\n", "-"]) for _ in range(n))
    items = [(i if i else None, text(rng.choice([0, 1, 2, 5, 12, 25]))) for i in range(12)] + [(3, None), (4, items_text := text(14)), (5, items_text)]
    docs = [(i, text(rng.choice([0, 1, 3, 40, 300])) + rng.choice([x or "" for _, x in items])) for i in range(25)] + [(99, None), (99, ""), (None, items_text * 2)]
    return docs, items


def rows(spark, docs, items, **more):
    d = spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id long, text string, LEAK int")
    b = spark.createDataFrame(items, "item_id long, text string")
    got = D.find_contamination(d, b, **more).select("doc_id", "leak.*").collect()
    for r in got:
        assert r.n_hit == sum(b - a for a, b in r.spans)
    return sorted(((r.doc_id, r.n_words, r.n_hit, r["items"]) for r in got), key=str)


def test_equals_brute_force(spark):
    for seed in range(3):
        docs, items = random_case(seed)
        assert rows(spark, docs, items) == sorted(brute(docs, items), key=str)


def test_blocks_give_the_same(spark):
    docs, items = random_case(7)
    assert rows(spark, docs, items, block_words=40) == sorted(brute(docs, items), key=str)


def test_empty_tables(spark):
    assert rows(spark, [], [(1, "a b")]) == []
    assert rows(spark, [(1, "a b")], []) == [(1, 2, 0, [])]


def test_lanes_lose_nothing():
    rng = np.random.default_rng(1)
    ids = rng.integers(0, 4, 5_000).astype(np.int32)
    patterns = np.unique(rng.integers(1, 4, (60, 5)).astype(np.int32), axis=0)
    starts, found = D.Machine(patterns).search(ids)
    want = {(i, k) for i in range(len(ids) - 4) for k, p in enumerate(patterns) if (ids[i : i + 5] == p).all()}
    assert set(zip(starts.tolist(), found.tolist(), strict=True)) == want
