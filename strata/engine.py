"""The engine: ``sql(text)`` takes platform commands, and gives all other text to Spark SQL."""

from __future__ import annotations

import logging
import threading
import time
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession

from . import bodies
from .builds import Builds
from .catalog import Catalog, missing
from .errors import INVALID_PARAMETER_VALUE, StrataError
from .flows import Flows
from .operators import history
from .plans import commands as C
from .plans.lexer import spans, statements
from .plans.parser import match
from .sources import connectors
from .sources.files import open_files
from .sources.metalog import TABLES, MetaLog
from .sources.secretbox import SecretBox
from .sources.storage import SpecStorage
from .streaming.tail import follow, journal_stream, line

META_SCHEMA = "_meta"


class Claims:
    """Which engines live: each that runs something renews a file; a stale one is dead."""

    FOLDER, EVERY, STALE, CLOCKS_DIFFER = "_meta/alive", 5.0, 30.0, 300.0

    def __init__(self, files, owner: str):
        self.files, self.owner, self.ended, self.thread = files, owner, threading.Event(), None
        self.seen: dict[str, tuple[bytes, float]] = {}

    def _renew(self) -> None:
        self.files.put(f"{self.FOLDER}/{self.owner}", repr(time.time()).encode())

    def hold(self) -> None:
        if self.thread is None:
            self._renew()
            self.thread = threading.Thread(target=self._keep, daemon=True)
            self.thread.start()

    def _keep(self) -> None:
        while not self.ended.wait(self.EVERY):
            self._renew()

    def alive(self, owner: str) -> bool:
        """False only without a claim, or if it was not renewed for long.

        A claim counts as renewed when its text changes, by this engine's clock; a claim
        seen for the first time is old only by far more than clocks of two machines differ.
        """
        if owner == self.owner:
            return not self.ended.is_set()
        name = f"{self.FOLDER}/{owner}"
        try:
            claim = self.files.read(name)
        except Exception:
            if self.files.exists(name):
                raise
            return False
        seen, since = self.seen.get(owner, (None, 0.0))
        if seen != claim:
            self.seen[owner] = claim, time.monotonic()
            return seen is not None or time.time() - float(claim) < self.STALE + self.CLOCKS_DIFFER
        return time.monotonic() - since < self.STALE

    def release(self) -> None:
        self.ended.set()
        self.files.drop(f"{self.FOLDER}/{self.owner}")


class Engine:
    """One installation under ``root``.

    ``key`` (32 bytes) opens the secrets of connections. ``poll`` is how often flows and
    tails look again. Engines on other drivers may use the same root at the same time.
    """

    def __init__(self, spark: SparkSession, root: str, user: str = "user", key: bytes | None = None, poll: float = 2.0):
        self.spark, self.user, self.owner = spark, user, uuid.uuid4().hex
        self.files = open_files(spark, root)
        self.meta = MetaLog(self.files)
        self.secrets = SecretBox(spark, key)
        self.claims = Claims(self.files, self.owner)
        self.catalog = Catalog(self.meta, self.secrets, user)
        self.builds = Builds(self)
        self.flows = Flows(self, poll)
        self.poll = min(poll, 1.0)
        self.meta.refresh()

    def close(self) -> None:
        """Stop what runs here."""
        for run in list(self.flows.runs.values()):
            run.stop("the engine is closed")
            run.thread.join(60)
        for n in list(self.builds.runs):
            self.builds.cancel(n, "the engine is closed")
            self.builds.wait(n, 60)
        self.claims.release()

    # Text.

    def sql(self, text: str) -> DataFrame:
        """A command's answer, or the result of a query, as a DataFrame."""
        command = match(text)
        if command is None:
            return self.query(text)
        answer = self.execute(command, text)
        if answer.column:
            return self.spark.createDataFrame([(answer.value,)], f"{answer.column} bigint")
        return self.spark.createDataFrame([(x,) for x in [*answer.lines, answer.tag]], "message string")

    def execute(self, command: object, text: str = "") -> C.Answer:
        self.meta.refresh()
        answer = C.Answer(C.TAGS[type(command)])
        catalog = self.catalog
        match command:
            case C.CreateWorkspace():
                catalog.create_workspace(command, text)
            case C.DropWorkspace():
                self._drop_workspace()
            case C.AddSchema():
                catalog.add_schema(command, text)
            case C.CreateDataset():
                catalog.create_dataset(command, text)
            case C.DropDataset():
                catalog.drop_dataset(command, text)
            case C.CreateBuildSpec():
                catalog.create_build_spec(command, text)
            case C.DropBuildSpec():
                self._drop_build_spec(command, text)
            case C.CreateFlowSpec():
                catalog.create_flow_spec(command, text)
            case C.DropFlowSpec():
                catalog.drop_flow_spec(command, text)
            case C.Comment():
                catalog.comment(command, text)
            case C.CreateConnection():
                catalog.create_connection(command, text)
            case C.TestConnection():
                self._jdbc(catalog.connection(command.name)).probe()
            case C.PythonBlock():
                self._python(command, answer.lines.append)
            case C.Build():
                answer.column, answer.value = "build_id", self.builds.start(command)
            case C.Flow():
                answer.column, answer.value = "flow_id", self.flows.start(command)
            case C.Attach():
                answer.lines += [line(r) for r in self.attach(int(self.builds.find(command.build_id)[0]["build_id"]), command.after)]
            case C.AttachFlow():
                answer.lines += [line(r) for r in self.attach_flow(int(self.flows.find(command.flow_id)[0]["flow_id"]), command.after)]
            case C.Stop():
                self.builds.stop(command)
            case C.Fix():
                self.builds.fix(command)
            case C.PauseFlow():
                self.flows.pause(command)
            case C.ResumeFlow():
                self.flows.resume(command)
            case C.StopFlow():
                self.flows.stop(command)
        return answer

    def query(self, text: str) -> DataFrame:
        """Spark SQL over the session's tables and this workspace's datasets and metadata.

        ``schema.dataset``, ``schema.dataset_N``, ``schema.dataset_N_$`` and ``_meta.table``
        are views of the state at this moment.
        """
        found = statements(text)
        if len(found) == 1:
            text = found[0].text
        views: dict[tuple[str, str], str] = {}
        resolved = self._resolved(text, views)
        try:
            return self.spark.sql(resolved)  # which resolves names at once, so views can go
        finally:
            for view in views.values():
                self.spark.catalog.dropTempView(view)

    def _resolved(self, text: str, made: dict[tuple[str, str], str]) -> str:
        """``text`` with views in place of the workspace's names; ``made`` gets these views."""
        if not self.meta.installed():
            return text
        schemas = {*self.catalog.require()["usage"].split(","), META_SCHEMA}
        parts = [(s.kind, text[s.start : s.stop]) for s in spans(text)]
        out, k = [], 0
        while k < len(parts):
            kind, raw = parts[k]
            own = kind == "word" and raw.lower() in schemas and not (out and out[-1] == ".")
            if own and k + 2 < len(parts) and parts[k + 1][1] == "." and parts[k + 2][0] == "word":
                name, used = parts[k + 2][1].lower(), 3
                if name.endswith("_") and k + 3 < len(parts) and parts[k + 3][1] == "$":
                    name, used = name + "$", 4
                view = made.get((raw.lower(), name)) or self._view(raw.lower(), name)
                if view:
                    made[raw.lower(), name] = view
                    out.append(f"`{view}`")
                    k += used
                    continue
            out.append(raw)
            k += 1
        return "".join(out)

    def _view(self, schema: str, name: str) -> str | None:
        try:
            df = self.metadata(name) if schema == META_SCHEMA else self.table(f"{schema}.{name}")
        except StrataError:
            return None
        view = f"strata_{schema}_{name}".replace("$", "iface") + f"_{uuid.uuid4().hex[:8]}"
        df.createOrReplaceTempView(view)
        return view

    # Tables.

    def metadata(self, name: str) -> DataFrame:
        if name not in TABLES:
            raise missing(f"metadata table {name!r}")
        return self.meta.frame(self.spark, name)

    def storage(self, dataset: str, num: int) -> SpecStorage:
        spec = self.catalog.spec(dataset, num)
        attrs = self.catalog.attrs(dataset, self.catalog.dataset(dataset)["version_id"])
        return SpecStorage(self.spark, self.files, self.meta, dataset, num, self.catalog.storage_version(dataset, num), attrs, spec["chunk_attr_code"])

    def table(self, code: str) -> DataFrame:
        """The view of a dataset, the history of one of its specs (``_N``), or what landed (``_N_$``)."""
        self.meta.refresh()
        plain = code.lower()
        row = self.meta.last("dataset", dataset_code=plain)
        if row is not None and not row["is_deleted"]:
            specs = self.catalog.live_specs(plain)
            if not specs:
                attrs = self.catalog.attrs(plain, row["version_id"])
                return history.empty_history(self.spark, [(a["attr_code"], a["type_code"], a["is_primary"]) for a in attrs])
            return history.dataset_view([self.storage(plain, s["build_spec_num"]).history(row["type_code"]) for s in specs])
        landed = plain.endswith("_$")
        base, _, num = plain.removesuffix("_$").rpartition("_")
        if not num.isdigit():
            raise missing(f"table {code!r}")
        storage = self.storage(base, int(num))
        return storage.landed() if landed else storage.history(self.catalog.dataset(base)["type_code"])

    def _parts(self, code: str, read: Callable[[SpecStorage, str], DataFrame]) -> DataFrame | None:
        """The union of ``read`` over a dataset's live specs, or of one spec; None if there is nothing to read."""
        self.meta.refresh()
        plain = code.lower()
        row = self.meta.last("dataset", dataset_code=plain)
        if row is not None and not row["is_deleted"]:
            found = [read(self.storage(plain, s["build_spec_num"]), row["type_code"]) for s in self.catalog.live_specs(plain)]
            return history.dataset_view(found) if found else None
        base, _, num = plain.rpartition("_")
        if not num.isdigit():
            return None
        return read(self.storage(base, int(num)), self.catalog.dataset(base)["type_code"])

    def current(self, code: str) -> DataFrame:
        """Open versions, tombstones too: the table where ``end_build_id`` is null, without its history."""
        found = self._parts(code, lambda storage, kind: storage.current(kind))
        return self.table(code) if found is None else found

    def as_of(self, code: str, build_id: int) -> DataFrame:
        found = self._parts(code, lambda storage, kind: storage.as_of(kind, build_id))
        return self.table(code) if found is None else found

    def delta(self, code: str, from_build_id: int, to_build_id: int, current: bool = True) -> DataFrame:
        found = self._parts(code, lambda storage, kind: storage.delta(kind, from_build_id, to_build_id, current))
        return self.table(code) if found is None else found

    def warn(self, text: str) -> None:
        logging.getLogger("strata").warning(text)

    # Journals.

    def attach(self, build_id: int, after: int = 0) -> Iterator[dict]:
        return follow(self.meta, "build", build_id, after, self.poll)

    def attach_flow(self, flow_id: int, after: int = 0) -> Iterator[dict]:
        return follow(self.meta, "flow", flow_id, after, self.poll)

    def stream(self, table: str = "build_log") -> DataFrame:
        return journal_stream(self.spark, self.files.path(MetaLog.FOLDER), table)

    # Connections and bodies.

    def _jdbc(self, row: dict) -> connectors.JdbcHandle:
        return connectors.JdbcHandle(self.spark, row["class_code"], self.secrets.open_fields(row["param_json"]))

    def connection_factory(self, code: str) -> Callable:
        return connectors.factory(lambda: self._jdbc(self.catalog.connection(C.Ref(code))))

    def warehouse_factory(self, land: Callable[[DataFrame], None] | None = None) -> Callable:
        reads = {"sql": self.query, "table": self.table, "current": self.current, "as_of": self.as_of, "delta": self.delta}
        return connectors.factory(lambda: connectors.WarehouseHandle(self.spark, reads, land))

    def _python(self, c: C.PythonBlock, say: Callable[[str], None]) -> None:
        self.catalog.require()
        names = {r["connection_code"]: self.connection_factory(r["connection_code"]) for r in self.meta.current("connection", "connection_code")}
        bodies.run(c.body.text, names | {connectors.WAREHOUSE: self.warehouse_factory()}, say, c.body.pos)

    # Drops that reach storage.

    def _drop_build_spec(self, c: C.DropBuildSpec, text: str) -> None:
        storage = self.storage(c.spec.dataset, c.spec.num) if self.meta.installed() and self._has_spec(c.spec) else None
        self.catalog.drop_build_spec(c, text)
        if storage is not None:
            storage.drop()

    def _has_spec(self, spec: C.SpecRef) -> bool:
        row = self.meta.last("build_spec", dataset_code=spec.dataset, build_spec_num=spec.num)
        return row is not None and not row["is_deleted"]

    def _drop_workspace(self) -> None:
        self.catalog.require()
        if self.builds.runs or self.flows.runs:
            raise StrataError("builds or flows are running", sqlstate=INVALID_PARAMETER_VALUE)
        for folder in (MetaLog.FOLDER, MetaLog.CHECKPOINTS, "data", "iface"):
            self.files.drop(folder)
        self.meta.__init__(self.files)
