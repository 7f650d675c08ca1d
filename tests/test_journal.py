"""The engine's indexed reads of its journals equal the plans over the journals as tables."""

import random
from datetime import UTC, datetime, timedelta

import pytest
from strata.builds import RUNNING, Builds
from strata.catalog import Catalog
from strata.plans import journal as J
from strata.plans.graph import CLEAN
from strata.sources.files import LocalFiles
from strata.sources.metalog import MetaLog, full_row


@pytest.fixture(params=[1, 2, 3])
def meta(request, tmp_path):
    """A journal of random builds and flows over random specs."""
    rng, log = random.Random(request.param), MetaLog(LocalFiles(str(tmp_path)))
    start = datetime(2024, 1, 1, tzinfo=UTC)
    names = [f"s.d{k}" for k in range(4)]
    version, tick = 0, 0
    for _ in range(12):
        version += 1
        d, n, gone = rng.choice(names), rng.randint(1, 2), rng.random() < 0.25
        rows = {"dataset": [full_row("dataset", dataset_code=d, version_id=version, type_code="store", is_deleted=False)]}
        rows["build_spec"] = [full_row("build_spec", dataset_code=d, build_spec_num=n, version_id=version, is_deleted=gone)]
        rows["build_spec_mode"] = [full_row("build_spec_mode", dataset_code=d, build_spec_num=n, version_id=version, mode_code=m, type_code="init") for m in rng.sample(["initial", "increment", "own"], 2)]
        rows["build_spec_source"] = [full_row("build_spec_source", dataset_code=d, build_spec_num=n, version_id=version, source_dataset_code=s) for s in rng.sample(names, rng.randint(0, 2))]
        log.commit(lambda _, rows=rows: rows)
    runs = []
    for k in range(1, 25):
        if k % 4 == 1:
            flow = full_row("flow", flow_id=k // 4 + 1, version_id=version, user_code="u", intake_code="calc", export_code="calc", owner="o")
            log.commit(lambda _, flow=flow: {"flow": [flow]})
            runs.append(("flow", k // 4 + 1, iter(rng.choice([["wait"], ["wait", "exec", "hold"], ["wait", "exec", "done"], ["wait", "stop"]]))))
        build = full_row("build", build_id=k, version_id=version, flow_id=rng.choice([None, k // 4 + 1]), dataset_code=rng.choice(names), build_spec_num=rng.randint(1, 2), mode_code=rng.choice(["initial", "increment", "own"]), owner="o")
        log.commit(lambda _, build=build: {"build": [build]})
        runs.append(("build", k, iter(rng.choice([["wait"], ["wait", "load"], ["wait", "load", "comp", "done"], ["wait", "load", "comp", "done"], ["wait", "load", "fail"], ["wait", "fail", "fix"]]))))
    while runs:
        run = rng.choice(runs)
        kind, number, left = run
        status = next(left, None)
        if status is None:
            runs.remove(run)
            continue
        tick += 1
        row = full_row(f"{kind}_log", **{f"{kind}_log_id": log.next_id(f"{kind}_log", f"{kind}_log_id"), f"{kind}_id": number}, log_time=start + timedelta(seconds=tick), status_code=status, version_id=version)
        log.commit(lambda _, table=f"{kind}_log", row=row: {table: [row]})
    return log


def found(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_reads_of_journals(spark, meta):
    catalog = Catalog(meta, None, "u")
    builds = Builds.__new__(Builds)
    builds.meta, builds.catalog = meta, catalog
    f = {t: meta.frame(spark, t).cache() for t in ("build", "build_log", "flow", "flow_log", "build_spec", "build_spec_source", "build_spec_mode")}
    for kind in ("build", "flow"):
        last = {r[0]: r[1] for r in J.last_status(f[f"{kind}_log"], f"{kind}_id", f"{kind}_log_id").collect()}
        assert last == {n: meta.status(kind, n) for n in last}
        assert J.next_id(f[kind], f"{kind}_id").first()[0] == meta.next_id(kind, f"{kind}_id")
    assert found(J.unfinished(f["build"], f["build_log"]).select("build_id", "status_code")) == sorted([(b["build_id"], s) for b, s in meta.unfinished("build")], key=str)
    assert found(J.unfinished(f["build"], f["build_log"], RUNNING).select("build_id")) == sorted([(b["build_id"],) for b, s in meta.unfinished("build") if s in RUNNING], key=str)
    assert found(J.open_flows(f["flow_log"]).select("flow_id")) == sorted([(r["flow_id"],) for r, _ in meta.unfinished("flow")], key=str)
    assert found(J.live(f["build_spec"], ["dataset_code", "build_spec_num"]).select("dataset_code", "build_spec_num")) == sorted([(s["dataset_code"], s["build_spec_num"]) for s in catalog.live_specs()], key=str)
    assert found(J.live_edges(f["build_spec"], f["build_spec_source"])) == sorted(catalog.edges(), key=str)
    modes = sorted([(s["dataset_code"], s["build_spec_num"], sorted(m["mode_code"] for m in catalog.of_spec("build_spec_mode", s))) for s in catalog.live_specs()], key=str)
    assert found(J.mode_sets(f["build_spec"], f["build_spec_mode"])) == modes
    assert J.window_to_manual(f["build"], f["flow_log"]).first()[0] == builds.window_to(99, "mart", None)
    windows = set()
    for d in (f"s.d{k}" for k in range(4)):
        assert {(r[0], r[1]) for r in J.reader_specs(f["build_spec"], f["build_spec_source"], d).collect()} == {(x, n) for x, n, s in catalog.edges() if s == d}
        for n in (1, 2):
            r = J.window_from(f["build"], f["build_log"], d, n).first()
            since = r.previous_time and r.previous_time.astimezone(UTC)
            assert (r.from_build_id, since) == builds.window_from(d, n)
            windows |= {(d, n)} if r.from_build_id else set()
            mine = [(b["build_id"], s) for b, s in [catalog.open_build(d, n) or (None, None)] if b]
            assert found(J.open_build(f["build"], f["build_log"], d, n)) == mine
    assert {tuple(r) for r in J.with_window(f["build"], f["build_log"]).collect()} == windows and CLEAN
