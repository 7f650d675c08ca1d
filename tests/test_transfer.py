import random
import re

import pytest
from pyspark.sql import functions as F
from strata.errors import StrataError
from strata.operators import history as H
from strata.operators import transfer as T

SHAPE = T.Shape(("sec", "id"), ("v", "w"), "sec")
SLICE = "sec long, id long, is_active boolean, v long, w string"
LOG = "sec long, id long, build_id long, is_active boolean, v long, w string"


def model(kind, slice_, open_):
    """One row at a time: the rules of a merge. ``open_``: key -> (active, rest)."""
    chosen = {}
    for sec, k, act, v, w in slice_:
        rank = (0 if act is None else 1 if act else 2, v is None, v or 0, w is None, w or "")
        if (sec, k) not in chosen or rank < chosen[sec, k][0]:
            chosen[sec, k] = (rank, bool(act), (v, w))
    secs = {r[0] for r in slice_}
    keys = set(chosen)
    if kind == "init":
        keys |= set(open_)
    if kind == "sect":
        keys |= {k for k in open_ if k[0] in secs}
    out = {}
    for k in keys:
        _, act, rest = chosen.get(k, (None, False, None))
        was, old = open_.get(k, (False, (None, None)))
        if act != was or (act and rest != old):
            out[k] = (act, rest if act else old, act and not was, act and was, not act and was)
    return out


@pytest.mark.parametrize("seed", range(4))
def test_merges_equal_the_model_over_several_builds(spark, seed):
    rng = random.Random(seed)
    log, open_, ends = [], {}, {}
    for build in range(1, 5):
        kind = rng.choice(["init", "incr", "sect"])
        rows = [(rng.randint(1, 3), rng.randint(1, 8), rng.choice([True, True, True, False, None]), rng.randint(1, 2), rng.choice("ab")) for _ in range(rng.randint(0, 20))]
        df = spark.createDataFrame(rows, SLICE)
        old = spark.createDataFrame(log, LOG)
        got = T.merge(df, old, kind, SHAPE).collect()
        want = model(kind, rows, open_)
        assert {(r.sec, r.id): (r.is_active, (r.v, r.w), bool(r.inserted), bool(r.updated), bool(r.deleted)) for r in got} == want and len(got) == len(want)
        stats = T.statistics(T.merge(df, old, kind, SHAPE)).first()
        assert list(stats) == [sum(w[k] for w in want.values()) for k in (2, 3, 4)]
        for (sec, k), (act, rest, *_) in want.items():
            if (sec, k) in open_:
                ends[sec, k, ends[sec, k]] = build - 1
            ends[sec, k] = build
            open_[sec, k] = (act, rest)
            log.append((sec, k, build, act, *rest))
    history = H.store_history(spark.createDataFrame(log, LOG), SHAPE).collect()
    assert {(r.sec, r.id, r.build_id): r.end_build_id for r in history} == {(s, k, b): ends.get((s, k, b)) for s, k, b, *_ in log}


def test_incremental_merge_does_not_shuffle_the_log(spark, tmp_path):
    log = spark.range(1000).selectExpr("id % 10 AS sec", "id", "1L AS build_id", "true AS is_active", "id AS v", "'a' AS w")
    spark.createDataFrame([(1, 11, True, 5, "b")], SLICE).write.parquet(str(tmp_path / "slice"))
    slice_ = spark.read.parquet(str(tmp_path / "slice"))
    plan = T.narrowed(log, slice_, "incr", SHAPE)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "LeftSemi" in plan


def test_null_flag_wins_and_counts_as_inactive(spark):
    df = spark.createDataFrame([(1, 1, True, 5, "a"), (1, 1, None, 6, "b")], SLICE)
    [r] = T.one_per_key(df, SHAPE).collect()
    assert r.is_active is None and r.v == 6


def test_empty_slices(spark):
    log = spark.createDataFrame([(1, 1, 1, True, 5, "a")], LOG)
    none = spark.createDataFrame([], SLICE)
    assert [r.deleted for r in T.merge(none, log, "init", SHAPE).collect()] == [1]
    assert T.merge(none, log, "sect", SHAPE).count() == T.merge(none, log, "incr", SHAPE).count() == 0
    assert tuple(T.statistics(T.nothing(none, SHAPE)).first()) == (0, 0, 0)


def test_validations(spark):
    ok = spark.createDataFrame([(1, 1, True, 5, "a"), (1, 1, None, None, None), (1, 2, False, None, None)], SLICE)
    seen = T.survey(ok, SHAPE)
    assert seen == {"rows": 3, "null_keys": 0, "lacking": 0}
    T.validate(ok, seen, SHAPE, True)
    for bad, unique in (([(None, 1, False, 1, "a")], False), ([(1, 1, True, None, "a")], True), ([(1, 1, True, 1, "a")] * 2, True)):
        df = spark.createDataFrame(bad, SLICE)
        with pytest.raises(StrataError):
            T.validate(df, T.survey(df, SHAPE), SHAPE, unique)
    made = spark.createDataFrame([(1, 1, True, None, "a", 1, 0, 0), (1, 2, False, None, "a", 0, 0, 1)], SLICE + ", inserted int, updated int, deleted int")
    assert T.outcome(made, SHAPE) == ({"inserted_row_cnt": 1, "updated_row_cnt": 0, "deleted_row_cnt": 1}, 1)
    with pytest.raises(StrataError):
        T.check_values(1)
    assert T.duplicate_key_count(spark.createDataFrame([(1, None, True, 1, "a")] * 3, SLICE), SHAPE).first()[0] == 2


def test_dispatch_and_marts(spark):
    assert [T.plan_transfer("store", k, e) for k, e in (("init", True), ("init", False), ("sect", False))] == ["bulk", "merge", "merge"]
    assert [T.plan_transfer("mart", k, False) for k in ("init", "appd", "skip")] == ["bulk", "bulk", "skip"]
    log = spark.createDataFrame([(1, 1, b, True, b, "a") for b in (1, 2, 3, 4)], LOG)
    got = H.mart_history(log, SHAPE, [3]).collect()
    assert {r.build_id: r.end_build_id for r in got} == {1: 2, 2: 2, 3: None, 4: None}


def test_as_of_and_delta(spark):
    df = spark.createDataFrame([("a", 5, None, True), ("b", 3, 4, True), ("c", 5, None, False)], "k string, build_id long, end_build_id long, is_active boolean")
    assert sorted(r.k for r in H.as_of(df, 5).collect()) == ["a", "c"] and [r.k for r in H.as_of(df, 3).collect()] == ["b"]
    assert [r.k for r in H.delta(df, 4, 5).collect()] == ["a"] and len(H.delta(df, 0, 5, current=False).collect()) == 3


def test_reads_from_the_log_equal_those_from_history(spark):
    rng = random.Random(4)
    log = spark.createDataFrame([(k % 3, k, b, rng.random() < 0.8, b, "a") for k in range(12) for b in sorted(rng.sample(range(1, 9), rng.randint(1, 6)))], LOG)
    whole = H.store_history(log, SHAPE).cache()
    same = lambda a, b: sorted(map(tuple, a.collect()), key=str) == sorted(map(tuple, b.select(*a.columns).collect()), key=str)
    assert same(H.store_current(log, SHAPE), whole.filter("end_build_id is null"))
    for p in range(10):
        assert same(H.store_as_of(log, SHAPE, p), H.as_of(whole, p))
        for q in range(p, 10):
            for current in (True, False):
                assert same(H.store_delta(log, SHAPE, p, q, current), H.delta(whole, p, q, current))


def test_delta_and_as_of_prune_folders(spark, tmp_path):
    spark.createDataFrame([(1, k, b, True, b, "a") for k in range(5) for b in (1, 2, 3, 4)], LOG).write.partitionBy("build_id").parquet(f"{tmp_path}/log")
    log = spark.read.parquet(f"{tmp_path}/log").select("sec", "id", F.col("build_id").cast("long").alias("build_id"), "is_active", "v", "w")
    plan = H.store_delta(log, SHAPE, 2, 3)._jdf.queryExecution().executedPlan().toString()
    filters = re.findall(r"PartitionFilters: \[[^\]]*\]", plan)
    assert filters and all("> 2" in f for f in filters) and "Window" not in plan
    plan = H.store_as_of(log, SHAPE, 2)._jdf.queryExecution().executedPlan().toString()
    assert sorted("<= 2" in f for f in re.findall(r"PartitionFilters: \[[^\]]*\]", plan)) == [False, True] and "Window" not in plan
