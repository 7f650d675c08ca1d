"""Through command text: a library's shelves and loans, built, exported and conducted."""

import itertools
import json
import random
import threading
import time

import pytest
from pyspark.sql import functions as F
from strata.engine import Engine
from strata.errors import StrataError
from strata.sources import connectors, metalog, storage

SHELF = "create store dataset lib.shelf (branch text, isbn bigint, copies integer, note text, primary key (branch, isbn))"
SHELF_SPEC = """create build_spec lib.shelf.1 (init mode initial, incr mode increment, sect mode by_branch)
with (parallel = 3, chunk_attr = branch) as python $$
    print("landing", mode_code)
    with warehouse() as w:
        w.write_interface(w.sql("select * from delivery"))
$$"""
ROWS = "branch string, isbn bigint, copies int, note string, is_active boolean"
LETTERS = "create mart dataset lib.letter (branch text, isbn bigint, copies integer, primary key (branch, isbn))"
LETTERS_SPEC = """create build_spec lib.letter.7 (skip, appd mode increment, init mode initial, appd mode again) with (chunk_attr = isbn) from lib.shelf as python $$
with warehouse() as w:
    new = w.sql(f"select branch, isbn, copies, is_active, build_id from lib.shelf where end_build_id is null")
    w.write_interface(new.where(f"is_active and build_id > {from_build_id} and build_id <= {to_build_id}").drop("build_id"))
$$"""
ENDLESS = """create build_spec lib.{0}.1 (init mode initial) with (chunk_attr=x) as python $$
import time
while True:
    time.sleep(0.02)
$$"""


def deliver(spark, rows):
    spark.createDataFrame(rows, ROWS).createOrReplaceTempView("delivery")


@pytest.fixture
def e(spark, tmp_path):
    engine = Engine(spark, str(tmp_path / "root"), user="ida", key=b"7" * 32, poll=0.05)
    engine.sql("create workspace (lib, old)")
    yield engine
    engine.close()


@pytest.fixture
def shelf(e):
    e.sql(SHELF)
    e.sql(SHELF_SPEC)
    return e


def run(e, spec, mode, status="done"):
    dataset, _, num = spec.rpartition(".")
    n = e.sql(f"build('{dataset}', {num}, '{mode}')").first()[0]
    assert e.builds.wait(n) == status, [r["message"] for r in e.meta.all("build_log", build_id=n)]
    return n


def conduct(e, text="flow()", status="done"):
    f = e.sql(text).first()[0]
    assert e.flows.wait(f) == status, [r["message"] for r in e.meta.all("flow_log", flow_id=f)]
    return f


def refused(e, text, sqlstate=None, part=""):
    with pytest.raises(StrataError) as x:
        e.sql(text)
    assert part in x.value.message and sqlstate in (None, x.value.sqlstate), (x.value.message, x.value.sqlstate)
    return x.value


def found(df, *columns):
    return sorted(map(tuple, (df.select(*columns) if columns else df).collect()), key=str)


def eventually(ready, seconds=60):
    end = time.monotonic() + seconds
    while not ready():
        assert time.monotonic() < end
        time.sleep(0.05)


class Model:
    """History of a store, one key at a time: lists of (build, active, values)."""

    def __init__(self):
        self.keys = {}

    def build(self, n, mode, rows):
        landed = {}
        for branch, isbn, copies, note, active in rows:
            rank = (0 if active is None else 1 if active else 2, copies, note)
            if (branch, isbn) not in landed or rank < landed[branch, isbn][0]:
                landed[branch, isbn] = rank, bool(active), (copies, note)
        branches = {r[0] for r in rows}
        counts = {"inserted": 0, "updated": 0, "deleted": 0}
        for key in sorted({*landed, *self.keys}):
            in_reach = key in landed or mode == "initial" or (mode == "by_branch" and key[0] in branches)
            past = self.keys.get(key, [])
            was, before = (past[-1][1], past[-1][2]) if past else (False, None)
            _, active, values = landed.get(key, (None, False, None))
            if not in_reach or not (active or was) or (active and was and values == before):
                continue
            counts["updated" if active and was else "inserted" if active else "deleted"] += 1
            self.keys.setdefault(key, []).append((n, active, values if active else before))
        return counts

    def history(self):
        out = []
        for key, versions in self.keys.items():
            ends = [v[0] - 1 for v in versions[1:]] + [None]
            out += [(*key, n, end, active, *values) for (n, active, values), end in zip(versions, ends, strict=True)]
        return sorted(out, key=str)


@pytest.mark.parametrize("seed", [1, 2])
def test_builds_equal_a_model(spark, shelf, monkeypatch, seed):
    monkeypatch.setattr(storage, "SNAPSHOT_EVERY", 3)
    e, model, rng, built = shelf, Model(), random.Random(seed), []
    for step in range(7):
        mode = "initial" if step in (0, 4) else rng.choice(["increment", "by_branch"])
        keys = rng.sample(list(itertools.product("abc", range(6))), rng.randint(3, 12))
        rows = [(b, i, rng.randint(1, 2), rng.choice(["x", "y"]), step == 0 or rng.random() < 0.7) for b, i in keys]
        if step:
            rows += [(b, i, 9, "late", rng.choice([None, False])) for b, i, *_ in rows[:1]]
        deliver(spark, rows)
        n = run(e, "lib.shelf.1", mode)
        log = e.meta.last("build_log", build_id=n)
        assert {"prepared": len(rows)} | model.build(n, mode, rows) == {k: log[f"{k}_row_cnt"] for k in ("prepared", "inserted", "updated", "deleted")}
        assert e.table("lib.shelf_1_$").count() == (0 if mode == "initial" else len(rows))
        built.append(n)
    want = model.history()
    assert found(e.table("lib.shelf")) == want == found(e.sql("select * from lib.shelf_1"))
    assert found(e.current("lib.shelf")) == [r for r in want if r[3] is None]
    assert len(e.meta.all("snapshot")) == 2
    for p, q in itertools.combinations([0, *built], 2):
        assert found(e.as_of("lib.shelf", q)) == [r for r in want if r[2] <= q and (r[3] is None or r[3] >= q)]
        assert found(e.delta("lib.shelf", p, q)) == [r for r in want if p < r[2] <= q and r[3] is None and r[4]]
        assert found(e.delta("lib.shelf", p, q, current=False)) == [r for r in want if p < r[2] <= q]


def test_what_a_build_says(spark, shelf):
    deliver(spark, [("a", 1, 1, "x", True)])
    n = run(shelf, "lib.shelf.1", "initial")
    assert [r["status_code"] for r in shelf.attach(n)] == ["wait", "load", "load", "comp", "done"] and list(shelf.attach(n, 10**9)) == []
    *lines, tag = [r.message for r in shelf.sql(f"attach({n})").collect()]
    assert tag == "ATTACH" and any("landing initial" in x for x in lines)
    stream = shelf.stream("build_log").writeStream.format("memory").queryName("shelf_journal").start()
    stream.processAllAvailable()
    stream.stop()
    assert {r.status_code for r in spark.sql(f"select * from shelf_journal where build_id = {n}").collect()} == {"wait", "load", "comp", "done"}


@pytest.mark.parametrize(
    ("mode", "rows", "part"),
    [
        ("initial", [("a", None, 1, "x", True)], "null in the primary key"),
        ("initial", [("a", 1, 1, "x", True), ("a", 1, 2, "x", True)], "repeat a primary key"),
        ("initial", [("a", 1, None, "x", True)], "lack a value"),
        ("increment", [("a", 5, None, "x", True), ("b", 1, 1, "x", True)], "lack a value"),
    ],
)
def test_bad_deliveries_fail_and_leave_nothing(spark, shelf, mode, rows, part):
    e, good = shelf, 0
    if mode == "increment":  # only a merge into what is there checks the versions that it makes
        deliver(spark, [("z", 1, 1, "x", True)])
        good = run(e, "lib.shelf.1", "initial")
    before = found(e.table("lib.shelf"))
    deliver(spark, rows)
    n = run(e, "lib.shelf.1", mode, "fail")
    assert part in e.meta.last("build_log", build_id=n)["message"] and found(e.table("lib.shelf")) == before
    assert f"fix({n})" in refused(e, f"build('lib.shelf', 1, '{mode}')").hint
    refused(e, f"stop({n})", "55000", "failed")
    e.sql(f"fix({n})")
    refused(e, f"fix({n})", "55000", "ended")
    assert e.builds.window_from("lib.shelf", 1)[0] == good


def test_windows_move_with_clean_builds_only(spark, shelf):
    e = shelf
    assert e.builds.window_from("lib.shelf", 1) == (0, None)
    deliver(spark, [("a", 1, 1, "x", True)])
    first = run(e, "lib.shelf.1", "initial")
    run(e, "lib.shelf.1", "by_branch")  # run by hand only
    last = e.meta.last("build_log", build_id=first)
    assert e.builds.window_from("lib.shelf", 1) == (first, last["log_time"])
    assert run(e, "lib.shelf.1", "increment") == e.builds.window_from("lib.shelf", 1)[0]
    refused(e, "build('lib.shelf', 1, 'weekly')", "42704")
    refused(e, "build('lib.shed', 1, 'initial')", "42704")
    refused(e, "stop(99)", "42704")


def test_bodies(e):
    e.sql("create store dataset lib.visit (x text, primary key (x))")
    body = "\nprint(*sorted(k for k in globals() if k[0] != '_'))\nprint(mode_code, from_build_id, to_build_id, previous_time, parallel_cnt)\n[][1]\n"
    e.sql(f"create build_spec lib.visit.1 (init mode initial) with (chunk_attr=x) as python $${body}$$")
    n = run(e, "lib.visit.1", "initial", "fail")
    names, values, failure = [r["message"] for r in e.meta.all("build_log", build_id=n) if r["message"]]
    assert names.split() == ["from_build_id", "mode_code", "parallel_cnt", "previous_time", "print", "to_build_id", "warehouse"]
    assert values == "initial 0 1 None 1" and failure.startswith("IndexError") and "line 4" in failure
    assert [r.message for r in e.sql("python $$with warehouse() as w: print(w.table('lib.visit').count(), 'rows')$$").collect()] == ["0 rows", "PYTHON"]
    assert refused(e, "python $$\n  if\n$$", part="no Python").pos is not None


def test_marts_by_flows_and_by_hand(spark, shelf):
    e = shelf
    e.sql(LETTERS)
    e.sql(LETTERS_SPEC)
    deliver(spark, [("a", 1, 1, "x", True), ("b", 1, 4, "x", True)])
    first = conduct(e)
    assert found(e.table("lib.letter"), "branch", "copies") == [("a", 1), ("b", 4)]
    deliver(spark, [("a", 2, 2, "x", True)])
    conduct(e, "flow(export = skip)")
    assert e.table("lib.letter").count() == 2  # gathered, and dropped by the skip
    deliver(spark, [("c", 3, 3, "x", True)])
    conduct(e)
    assert found(e.table("lib.letter"), "branch", "isbn") == [("a", 1), ("b", 1), ("c", 3)]
    n = run(e, "lib.letter.7", "initial")  # a resend in full ends all portions before it
    ended = e.table("lib.letter").filter(F.col("build_id") < n)
    assert found(ended.select("end_build_id").distinct()) == [(n - 1,)] and found(e.delta("lib.letter", n - 1, n, current=False), "branch") == found(e.current("lib.letter"), "branch")
    assert found(e.as_of("lib.letter", n - 1), "branch") == [("a",), ("b",), ("c",)]
    assert any("plan:" in r.message for r in e.sql(f"attach flow({first})").collect())
    assert e.sql("select count(distinct flow_id) from _meta.flow_log where status_code = 'done'").first()[0] == 3


def test_presets_run_what_their_query_names(spark, shelf):
    e = shelf
    e.sql(LETTERS)
    e.sql(LETTERS_SPEC)
    deliver(spark, [("a", 1, 1, "x", True)])
    conduct(e)
    spark.createDataFrame([("lib.shelf", 1, "by_branch", "x")], "dataset string, num int, mode string, why string").createOrReplaceTempView("todo")
    e.sql("create flow_spec weekly as $$select * from todo$$")
    f = conduct(e, "flow('weekly')")
    assert [(b["dataset_code"], b["mode_code"]) for b in e.meta.all("build", flow_id=f)] == [("lib.shelf", "by_branch"), ("lib.shelf", "increment"), ("lib.letter", "increment")]
    e.sql("create or replace flow_spec weekly as $$select 'lib.letter', 7, 'again'$$")
    assert "mart" in e.meta.last("flow_log", flow_id=conduct(e, "flow('weekly')", "stop"))["message"]
    e.sql("drop flow_spec weekly")
    refused(e, "flow('weekly')", "42704")


def test_a_failed_step_waits_for_its_fix(spark, shelf):
    e = shelf
    deliver(spark, [(None, 1, 1, "x", True)])
    f = e.sql("flow()").first()[0]
    steps = lambda: [e.meta.status("build", b["build_id"]) for b in e.meta.all("build", flow_id=f)]
    eventually(lambda: steps() == ["fail"])
    e.sql(f"pause flow({f})")
    refused(e, f"pause flow({f})", "55000")
    deliver(spark, [("a", 1, 1, "x", True)])
    e.sql(f"fix({e.meta.all('build', flow_id=f)[0]['build_id']})")
    time.sleep(0.3)
    assert steps() == ["fix"] and e.meta.status("flow", f) == "hold"
    e.sql(f"resume flow({f})")
    assert e.flows.wait(f) == "done" and steps() == ["fix", "done"]
    refused(e, f"resume flow({f})", "55000")
    refused(e, f"stop flow({f})", "55000")


def test_what_runs_keeps_others_out(e):
    for name in ("dust", "mould"):
        e.sql(f"create store dataset lib.{name} (x text, primary key (x))")
    e.sql(ENDLESS.format("dust"))
    e.sql("create build_spec lib.mould.1 (init mode initial) with (chunk_attr=x) from lib.dust as python $$pass$$")
    n = e.sql("build('lib.dust', 1, 'initial')").first()[0]
    refused(e, "build('lib.dust', 1, 'initial')", part="running")
    refused(e, "build('lib.mould', 1, 'initial')", part="busy")
    refused(e, "drop build_spec lib.dust.1", "55000")
    refused(e, ENDLESS.format("dust").replace("create", "create or replace"), "55000")
    e.sql(f"stop({n})")
    assert e.builds.wait(n) == "fail" and "stopped by ida" in e.meta.last("build_log", build_id=n)["message"]
    refused(e, "build('lib.mould', 1, 'initial')", part="busy")  # a source isn't whole before its fix
    e.sql(f"fix({n})")
    f = e.sql("flow()").first()[0]
    eventually(lambda: e.meta.all("build", flow_id=f))
    refused(e, "build('lib.mould', 1, 'initial')", part="flow")
    waiting = e.sql("flow()").first()[0]
    time.sleep(0.2)
    assert e.meta.status("flow", waiting) == "wait"
    for x in (waiting, f):
        e.sql(f"stop flow({x})")
    assert {e.flows.wait(f), e.flows.wait(waiting)} == {"stop"}
    assert e.meta.status("build", e.meta.all("build", flow_id=f)[0]["build_id"]) == "fix"


def test_builds_of_a_dead_engine(spark, e, tmp_path):
    e.sql("create store dataset lib.dust (x text, primary key (x))")
    e.sql(ENDLESS.format("dust"))
    other = Engine(spark, str(tmp_path / "root"), user="bo", poll=0.05)
    n = other.sql("build('lib.dust', 1, 'initial')").first()[0]
    thread = other.builds.runs[n].thread
    refused(e, f"stop({n})", part="another engine")
    other.claims.release()
    refused(e, "build('lib.dust', 1, 'initial')", part="orphaned")
    e.sql(f"stop({n})")
    assert e.meta.status("build", n) == "fail"
    e.sql(f"fix({n})")
    other.builds.cancel(n, "end")
    thread.join(30)


def test_liveness_is_judged_by_changes(e, monkeypatch):
    name = f"{e.claims.FOLDER}/far"
    assert not e.claims.alive("far")
    e.files.put(name, repr(time.time() - 100).encode())  # another machine's clock is late
    assert e.claims.alive("far") and e.claims.alive("far")
    monkeypatch.setattr(e.claims, "STALE", 0.0)
    assert not e.claims.alive("far")
    e.files.put(name, repr(time.time()).encode())
    assert e.claims.alive("far")
    monkeypatch.setattr(e.files, "read", lambda _: 1 / 0)
    with pytest.raises(ZeroDivisionError):  # storage that can't be read proves nothing
        e.claims.alive("far")


def test_demands_on_specs(shelf):
    e = shelf
    new = SHELF_SPEC.replace("shelf.1", "shelf.2")
    for change, part in (
        (("shelf.2", "shelf.0"), "1 at least"),
        ((", chunk_attr = branch", ""), "chunk_attr is missing"),
        (("chunk_attr = branch", "chunk_attr = note"), "not in the primary key"),
        (("parallel = 3", "parallel = 0"), "whole number"),
        (("parallel = 3", "parallel = many"), "whole number"),
        (("parallel = 3", "colour = 3"), "unknown option"),
        (("init mode initial", "sect mode initial"), "'sect'"),
        (("sect mode by_branch", "appd mode by_branch"), "'appd'"),
        (("sect mode by_branch", "skip"), "'skip'"),
        (("init mode initial, incr mode increment, ", ""), "initial or increment"),
        (("by_branch", "increment"), "listed twice"),
        (("as python", "using drum as python"), "does not exist"),
        (("as python", "using warehouse as python"), "warehouse"),
        (("as python", "from lib.shelf as python"), "own dataset"),
        (("as python", "from lib.attic as python"), "does not exist"),
    ):
        assert change[0] in new
        refused(e, new.replace(*change), part=part)
    several = refused(e, new.replace("parallel = 3, chunk_attr = branch", "parallel = 0, colour = 3"), "22023")
    assert "chunk_attr" in several.message and "colour" in several.hint and "parallel" in several.hint
    refused(e, SHELF_SPEC, "42710")


def test_catalog_commands(shelf):
    e = shelf
    refused(e, "create workspace (lib)", "42P06")
    refused(e, "alter workspace add old", "42P06")
    e.sql("alter workspace add raw")
    refused(e, "create store dataset gone.x (a text, primary key (a))", "3F000")
    refused(e, SHELF, "42710")
    refused(e, "drop dataset lib.shelf", "2BP01")
    again = SHELF.replace("create", "create or replace")
    for change in (("copies integer", "copies bigint"), ("(branch, isbn)", "(branch)"), ("copies integer, ", "")):
        refused(e, again.replace(*change), "0A000")
    e.sql("create store dataset lib.loan (who text, primary key (who))")
    e.sql("create build_spec lib.loan.1 (incr mode increment) with (chunk_attr=who) from lib.shelf as python $$pass$$")
    refused(e, SHELF_SPEC.replace("create", "create or replace").replace("as python", "from lib.loan as python"), part="circle")
    e.sql(LETTERS)
    refused(e, LETTERS_SPEC.replace("(skip, ", "("), part="skip")
    refused(e, SHELF_SPEC.replace("shelf.1", "shelf.2").replace("as python", "from lib.letter as python"), part="no source")
    for what, text in (("dataset lib.shelf", "books"), ("attr lib.shelf.copies", "how many"), ("workspace", "all of it")):
        e.sql(f"comment on {what} is '{text}'")
    refused(e, "comment on attr lib.shelf.shade is 'x'", "42704")
    e.sql(again)  # comments outlive it
    d = e.catalog.dataset("lib.shelf")
    assert (d["descr"], [a["descr"] for a in e.catalog.attrs("lib.shelf", d["version_id"])]) == ("books", [None, None, "how many", None])
    e.sql("drop build_spec lib.loan.1")
    e.sql("drop dataset lib.loan")
    refused(e, "drop dataset lib.loan", "42704")
    assert e.sql("select max(version_id) from _meta.version").first()[0] == e.meta.rows["version"][-1]["version_id"]
    e.sql("drop workspace")
    refused(e, "flow()", "42704")


def test_a_dropped_spec_starts_anew(spark, shelf):
    e = shelf
    deliver(spark, [("a", 1, 1, "x", True)])
    n = run(e, "lib.shelf.1", "initial")
    e.sql("drop build_spec lib.shelf.1")
    assert e.table("lib.shelf").count() == e.current("lib.shelf").count() == e.as_of("lib.shelf", n).count() == 0
    e.sql(SHELF_SPEC)
    assert e.table("lib.shelf").count() == 0 and e.builds.window_from("lib.shelf", 1)[0] == n  # journals stay
    run(e, "lib.shelf.1", "increment")
    e.sql(SHELF_SPEC.replace("create", "create or replace"))
    assert e.table("lib.shelf").count() == 1


def test_connections_hide_their_secrets(spark, e, tmp_path):
    fields = "host_name='127.0.0.1', port_num=1, database_name='d', user_name='u', password='hush!'"
    e.sql(f"create postgres connection drum with ({fields})")
    row = e.meta.last("connection", connection_code="drum")
    assert "hush!" not in json.dumps(e.meta.rows, default=str) and e.secrets.open_fields(row["param_json"])["password"] == "hush!"
    refused(e, "test drum", "08001")
    refused(e, "test horn", "42704")
    for change, part in ((("port_num=1", "port_num='1'"), "takes a number"), (("user_name='u'", "user_name='u', hat=1"), "no field"), (("password=", "user_name="), "twice"), ((", user_name='u', password='hush!'", ""), "needs a field")):
        refused(e, f"create or replace postgres connection drum with ({fields.replace(*change)})", part=part)
    refused(e, f"create postgres connection drum with ({fields})", "42710")
    refused(e, f"create postgres connection warehouse with ({fields})", "22023")
    with pytest.raises(StrataError):
        Engine(spark, str(tmp_path / "root"), key=b"8" * 32).secrets.open_fields(row["param_json"])


def test_two_engines_write_one_log(spark, e, tmp_path):
    other = Engine(spark, str(tmp_path / "root"))
    e.sql(SHELF)
    refused(other, SHELF, "42710")
    texts = [(x, f"comment on dataset lib.shelf is '{k}'") for k in range(6) for x in (e, other)]
    threads = [threading.Thread(target=x.sql, args=(t,)) for x, t in texts]
    for t in threads:
        t.start()
    for t in threads:
        t.join(60)
    e.meta.refresh()
    assert [v["version_id"] for v in e.meta.rows["version"]] == list(range(1, 15))


def test_a_start_reads_the_newest_checkpoint(spark, e, tmp_path, monkeypatch):
    monkeypatch.setattr(metalog, "FIRST_CHECKPOINT", 3)
    e.sql(SHELF)
    for k in range(12):
        e.sql(f"comment on dataset lib.shelf is '{k}'")
    assert [int(n.split(".")[0]) for n in e.files.names("_meta/checkpoint")] == [3, 6, 12]
    read = []
    files = type(e.files)(e.files.root)
    files.read = lambda name, plain=files.read: read.append(name) or plain(name)
    log = metalog.MetaLog(files)
    log.refresh()
    assert log.rows == e.meta.rows and len(read) == 3  # the checkpoint at 12, and commits 13 and 14


def test_views_of_a_query_do_not_stay(spark, shelf):
    before = {t.name for t in spark.catalog.listTables()}
    got = shelf.sql("select a.isbn from lib.shelf a join lib.shelf_1 b on a.isbn = b.isbn join _meta.version v on true")
    assert {t.name for t in spark.catalog.listTables()} == before and got.count() == 0


def test_a_body_moves_rows_over_jdbc(spark, e, monkeypatch):
    """Spark brings the embedded Derby; its addresses and probe stand in for a class of connections."""
    kind = connectors.CLASSES["postgres"]
    own = type(kind)(kind.fields, "jdbc:derby:memory:{database_name};create=true", "org.apache.derby.iapi.jdbc.AutoloadedDriver", "select 1 as one from sysibm.sysdummy1")
    monkeypatch.setitem(connectors.CLASSES, "postgres", own)
    e.sql("create postgres connection drum with (host_name='x', port_num=1, database_name='strata', user_name='app', password='p')")
    assert [r.message for r in e.sql("test drum").collect()] == ["TEST"]
    with e.connection_factory("drum")() as db:
        db.write(spark.createDataFrame([("a", k, k + 1, "n") for k in range(20)], "branch string, isbn long, copies int, note string"), "books")
    e.sql(SHELF)
    e.sql(SHELF_SPEC.replace("as python", "using drum as python").replace('w.write_interface(w.sql("select * from delivery"))', 'with drum() as db: w.write_interface(db.read("select * from books", "isbn", 0, 20, 4))'))
    run(e, "lib.shelf.1", "initial")
    assert e.table("lib.shelf").agg(F.count("*"), F.sum("copies")).first() == (20, 210)
