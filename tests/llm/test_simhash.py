import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F
from strata.llm import simhash as S

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_fingerprint(text, size=3):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = WORD.findall(low)
    shingles = [" ".join(w[i : i + size]) for i in range(len(w) - size + 1)] if len(w) >= size else [" ".join(w)] if w else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def roots(nodes, linked):
    up = {n: n for n in nodes}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in linked:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def near(rng, fp, flips):
    for b in rng.sample(range(64), flips):
        fp ^= 1 << b
    return fp


def test_fingerprints_equal_the_definition(spark):
    rng = random.Random(1)
    texts = [None, "", "  \n", "One", "one TWO", "  x", "İ É ß"] + [" ".join(rng.choice(["a", "B", "cé", "d\x1ce"]) for _ in range(rng.choice([3, 4, 50, 20_000]))) for _ in range(12)]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, simhash string")
    for r in S.with_fingerprints(df).collect():
        assert r.simhash.fp % (1 << 64) == plain_fingerprint(r.text)


@pytest.mark.parametrize("radius", [0, 1, 3, 6])
def test_bit_slices_find_what_comparing_pairs_finds(radius):
    rng = random.Random(radius)
    groups = []
    for size in (1, 2, 3, 64, 65, 66, 129, 200, 300):
        seeds = [rng.getrandbits(64) for _ in range(max(1, size // 5))]
        groups.append([near(rng, rng.choice(seeds), rng.randint(0, 2 * radius + 1)) for _ in range(size)])
    groups.sort(key=len, reverse=True)
    flat = [x for g in groups for x in g]
    got = S.components_of(np.array(flat, np.uint64)[:, None], np.array([len(g) for g in groups]), radius)
    at = 0
    for g in groups:
        n = len(g)
        want = roots(range(at, at + n), [(at + i, at + j) for i in range(n) for j in range(i) if (g[i] ^ g[j]).bit_count() <= radius])
        assert [want[at + i] for i in range(n)] == got[at : at + n].tolist()
        at += n


@pytest.mark.parametrize("tile", [8, 4096])
def test_components_of_fingerprints(spark, tile):
    rng = random.Random(4)
    fps = {0, near(rng, 0, 3)}
    for _ in range(30):
        chain = rng.getrandbits(64)
        for _ in range(rng.choice([1, 2, 20])):
            fps.add(chain)
            chain = near(rng, chain, rng.choice([1, 2, 3, 4]))
    fps = sorted(fps)
    want = roots(fps, [(a, b) for a in fps for b in fps if a < b and (a ^ b).bit_count() <= 3])
    df = spark.createDataFrame([(int(np.uint64(f).astype(np.int64)),) for f in fps], "fp long")
    edges = S.forest(df, 3, tile)
    got = {r.node % (1 << 64): r.root % (1 << 64) for r in S.star_components(edges).collect()}
    classes = lambda m: {frozenset(k for k in fps if m.get(k, k) == v) for v in {m.get(k, k) for k in fps}}
    assert classes(got) == classes(want)


def test_documents_and_ids(spark):
    long_ = " ".join(f"w{i}" for i in range(200))
    rows = [(5, "a b c"), (3, "A  B c"), (None, "a b c"), (9, long_), (8, long_), (8, long_), (7, None), (6, ""), (None, "alone here now")]
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, fp string")
    got = sorted(map(tuple, S.near_duplicates(df).select("doc_id", "component_id").collect()), key=str)
    assert got == sorted([(5, 3), (3, 3), (None, 3), (9, 8), (8, 8), (8, 8), (7, 6), (6, 6), (None, None)], key=str)
    assert S.near_duplicates(df.limit(0)).count() == 0


def test_long_chain_converges(spark):
    edges = spark.range(300).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    assert {r.root for r in S.star_components(edges).collect()} == {0}


def jaccard(a, b):
    s, t = (set(S.shingles_of(x.encode(), 5)) for x in (a, b))
    return len(s & t) / len(s | t)


def test_similar_documents_stay_once_and_others_stay(spark):
    rng = random.Random(11)
    words = [f"w{i}" for i in range(3000)]
    rows, edits = [], []
    for k in range(60):
        text = [rng.choice(words) for _ in range(400)]
        rows.append((3 * k, " ".join(text)))
        close = list(text)
        for at in rng.sample(range(400), 1 + k % 5):
            close[at] = "edited"
        edits.append((rows[-1], (3 * k + 1, " ".join(close))))
        far = [w if rng.random() < 0.8 else rng.choice(words) for w in text]
        edits.append((rows[-1], (3 * k + 2, " ".join(far))))
    rows += [e for _, e in edits] + [(999, rows[0][1]), (0, rows[0][1]), (None, rows[0][1]), (998, "alone"), (997, None), (996, "")]
    want = {i for i, _ in rows if i is not None and i < 900 and i % 3 != 1} | {998, 996}
    assert all((jaccard(a[1], b[1]) >= 0.85) == (b[0] % 3 == 1) for a, b in edits)
    df = spark.createDataFrame([(i, t, "x", i) for i, t in rows], "doc_id long, text string, group string, root long").repartition(4)
    got = S.one_of_each(df)
    assert got.columns == df.columns
    assert sorted(r.doc_id for r in got.collect()) == sorted(want)
    assert S.one_of_each(df.limit(0)).count() == 0


def test_many_words_compare_like_pairs():
    rng = np.random.default_rng(2)
    base = rng.integers(0, 1 << 63, (4, 4)).astype(np.uint64)
    fps = []
    for i in range(150):
        bits = np.unpackbits(base[i % 4].view(np.uint8))
        bits[rng.choice(256, rng.integers(0, 40), replace=False)] ^= 1
        fps.append(np.packbits(bits).view(np.uint64))
    fps = np.array(fps)
    got = S.components_of(fps, np.array([100, 50]), 39)
    d = np.bitwise_count(fps[:, None] ^ fps[None]).sum(axis=2)
    for a, b in ((0, 100), (100, 150)):
        want = roots(range(a, b), [(i, j) for i in range(a, b) for j in range(a, i) if d[i, j] <= 39])
        assert [want[i] for i in range(a, b)] == got[a:b].tolist()


def test_links_are_those_of_the_exact_similarity(spark):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(50_000)]
    rows, want = [], set()
    for k in range(240):
        n = rng.choice([10, 40, 400])
        text = [rng.choice(words) for _ in range(n)]
        copy = list(text)
        while jaccard(" ".join(text), " ".join(copy)) > 0.75 + 0.1 * k / 240:
            copy[rng.randrange(n)] = rng.choice(words)
        rows += [(2 * k, " ".join(text)), (2 * k + 1, " ".join(copy))]
        want |= {2 * k} if jaccard(rows[-2][1], rows[-1][1]) >= 0.8 else {2 * k, 2 * k + 1}
    assert 20 < 480 - len(want) < 220
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert {r.doc_id for r in S.one_of_each(df).collect()} == want


def test_exact_links_equal_brute_force():
    rng = np.random.default_rng(3)
    for similarity in (0.5, 0.8):
        sets = []
        for _ in range(20):
            base = rng.integers(0, 400, rng.choice([1, 4, 5, 60])).astype(np.uint64)
            sets += [np.unique(np.where(rng.random(len(base)) < 0.1, rng.integers(0, 400, len(base)), base).astype(np.uint64)) for _ in range(8)]
        plain = [set(s.tolist()) for s in sets]
        want = roots(range(len(sets)), [(i, j) for i in range(len(sets)) for j in range(i) if 5 * len(plain[i] & plain[j]) >= 5 * similarity * len(plain[i] | plain[j]) - 1e-6])
        assert [want[i] for i in range(len(sets))] == S.linked(sets, similarity).tolist()


def test_components_of_candidates_are_cut_into_parts(spark):
    rng = random.Random(6)
    base = [f"w{i}" for i in range(300)]
    texts = []
    for _ in range(60):
        texts.append(list(base))
        for at in rng.sample(range(300), 7):
            texts[-1][at] = f"x{rng.random()}"
    texts = [" ".join(t) for t in texts]
    want = roots(range(60), [(i, j) for i in range(60) for j in range(i) if jaccard(texts[i], texts[j]) >= 0.8])
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for part in (2000, S.PART):
        got = {r.doc_id: r.component_id for r in S.similar_documents(df, part=part, tile=16).collect()}
        assert got == want


def test_repeated_lines_count_once(spark):
    rng = random.Random(8)
    draw = lambda n: [f"w{rng.randrange(50_000)}" for _ in range(n)]
    line, text = " ".join(draw(12)) + "\n", draw(400)
    rows = [(k, " ".join(draw(300)) + "\n" + line * 60) for k in range(2)]
    rows += [(2, " ".join(text)), (3, " ".join(text) + "\n" + (" ".join(text[:12]) + "\n") * 30)]
    assert jaccard(rows[0][1], rows[1][1]) < 0.1 and jaccard(rows[2][1], rows[3][1]) > 0.9
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.doc_id for r in S.one_of_each(df).collect()) == [0, 1, 2]


def test_rows_are_marked_where_they_lie(spark):
    rows = spark.range(0, 80_000, 1, 2).select("id", F.monotonically_increasing_id().alias("row"), F.lit("x").alias("bitmap"))
    numbers = {r.id: r.row for r in rows.collect()}
    want = {0, 7, 8, 32_767, 32_768, 39_999, 40_000, 79_999, *random.Random(9).sample(range(80_000), 500)}
    marks = spark.createDataFrame([(numbers[i],) for i in want for _ in range(2)], "row long")
    got = S._in_place(rows, F.col("row"), marks, "hit")
    assert got.columns == ["id", "row", "bitmap", "hit"] and got.count() == 80_000
    assert {r.id for r in got.filter("hit").collect()} == want
    assert S._in_place(rows, F.col("row"), marks.limit(0), "hit").filter("hit").count() == 0


def test_rows_that_share_the_id_that_stays(spark):
    rng = random.Random(10)
    a, b, c = ([f"w{rng.randrange(50_000)}" for _ in range(100)] for _ in range(3))
    text = lambda words, last: " ".join([*words[:-1], last])
    rows = [(5, text(a, "z"), 1), (5, text(a, "b"), 2), (5, text(a, "b"), 2), (6, text(a, "a"), 3)]
    rows += [(None, text(b, "z"), 4), (None, text(b, "y"), 5), (None, text(c, "z"), 6), (9, text(c, "z"), 7)]
    df = spark.createDataFrame(rows, "doc_id long, text string, m_row long").repartition(3)
    assert sorted(tuple(r) for r in S.one_of_each(df).select("m_row", "doc_id").collect()) == [(2, 5), (5, None), (7, 9)]


def test_texts_stay_in_place_at_any_size(spark):
    rng = random.Random(12)
    draw = lambda: f"{rng.getrandbits(40):x}"
    texts = [[draw() for _ in range(3000)] for _ in range(100)]
    texts += [[*t[:-1], draw()] for t in texts[:5]]
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string").repartition(4).localCheckpoint()
    sc = spark.sparkContext

    def written() -> int:
        sc._jsc.sc().listenerBus().waitUntilEmpty()
        stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), None)
        return sum(stages.apply(k).shuffleWriteBytes() for k in range(stages.size()))

    before = written()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as if the tables of ids were large
    try:
        assert {r.doc_id for r in S.one_of_each(df).select("doc_id", F.length("text")).collect()} == set(range(100))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert written() - before < sum(len(" ".join(t)) for t in texts) / 2
