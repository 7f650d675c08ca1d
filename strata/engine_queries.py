"""Queries that go through the engine: commands, builds, flows, and reads of what they made.

Bills are the orders; S0 and S1 are the two states of ``queries``. Each query installs an
engine of its own in a scratch folder, which goes when the driver ends.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .engine import Engine
from .queries import BASE, changed_sql, first_slice, history_sql, query, second_slice
from .sources.files import open_files

BILL = "create store dataset shop.bill (o_custkey bigint, o_orderkey bigint, price numeric(18,2), o_orderstatus text, primary key (o_custkey, o_orderkey))"
BILL_SPEC = """create build_spec shop.bill.1 (init mode initial, incr mode increment, sect mode by_customer) with (chunk_attr = o_custkey, parallel = 4) as python $$
with warehouse() as w:
    w.write_interface(w.sql("select * from {view}"))
$$"""
SENT = "create mart dataset shop.sent (o_custkey bigint, o_orderkey bigint, price numeric(18,2), o_orderstatus text, primary key (o_custkey, o_orderkey))"
SENT_SPEC = """create build_spec shop.sent.1 (appd mode increment, init mode initial, skip) with (chunk_attr = o_custkey) from shop.bill as python $$
with warehouse() as w:
    w.write_interface(w.delta("shop.bill", from_build_id, to_build_id).drop("build_id", "end_build_id"))
$$"""
MODES = {"init": "initial", "incr": "increment", "sect": "by_customer"}


def scratch(spark: SparkSession) -> str:
    """A new folder that driver and executors share."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not shared and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not shared:
        shared = tempfile.mkdtemp(prefix="strata-")
        atexit.register(shutil.rmtree, shared, ignore_errors=True)
    root = f"{shared.rstrip('/')}/engine-{uuid.uuid4().hex}"
    atexit.register(open_files(spark, root).drop, "") if shared.startswith("/") else None
    return root


class Shop:
    """An engine with the store of bills, whose next delivery is a view."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir, self.view = spark, sf_dir, f"bills_{uuid.uuid4().hex}"
        self.engine = Engine(spark, scratch(spark), user="shop", key=bytes(32), poll=0.05)
        for text in ("create workspace (shop)", BILL, BILL_SPEC.format(view=self.view)):
            self.engine.sql(text)

    def deliver(self, state) -> None:
        state(self.spark, self.sf_dir).createOrReplaceTempView(self.view)

    def build(self, mode: str) -> None:
        n = self.engine.sql(f"build('shop.bill', 1, '{mode}')").first()[0]
        if self.engine.builds.wait(n, 3600) != "done":
            raise RuntimeError(self.engine.meta.last("build_log", build_id=n)["message"])

    def flow(self, text: str = "flow()") -> None:
        n = self.engine.sql(text).first()[0]
        if self.engine.flows.wait(n, 3600) != "done":
            raise RuntimeError(self.engine.meta.last("flow_log", flow_id=n)["message"])

    def after(self, kind: str) -> Engine:
        """The engine after a first load of S0 and a transfer of S1."""
        self.deliver(first_slice)
        self.build("initial")
        self.deliver(second_slice)
        self.build(MODES[kind])
        return self.engine


def _history(kind: str) -> None:
    @query(f"engine_history_{kind}", history_sql(kind), "price")
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return Shop(spark, sf_dir).after(kind).table("shop.bill")


for _kind in MODES:
    _history(_kind)


@query("engine_as_of", f"SELECT * FROM ({history_sql('init')}) WHERE build_id <= 1", "price")
def engine_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Shop(spark, sf_dir).after("init").as_of("shop.bill", 1)


@query("engine_delta", f"SELECT * FROM ({history_sql('incr')}) WHERE build_id > 1 AND end_build_id IS NULL AND is_active", "price")
def engine_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Shop(spark, sf_dir).after("incr").delta("shop.bill", 1, 2)


@query("engine_current", f"SELECT * FROM ({history_sql('sect')}) WHERE end_build_id IS NULL", "price")
def engine_current(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Shop(spark, sf_dir).after("sect").current("shop.bill")


COUNTS = f"""WITH {BASE}, d AS ({changed_sql('incr')})
    SELECT CAST(1 AS BIGINT) AS build_id, 'initial' AS mode_code, 'done' AS status_code, (SELECT count(*) FROM s0) AS prepared, (SELECT count(*) FROM s0) AS inserted, CAST(0 AS BIGINT) AS updated, CAST(0 AS BIGINT) AS deleted
    UNION ALL SELECT 2, 'increment', 'done', (SELECT count(*) FROM s1), sum(inserted)::BIGINT, sum(updated)::BIGINT, sum(deleted)::BIGINT FROM d"""


@query("engine_build_journal", COUNTS)
def engine_build_journal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Journals by the relay: names of the workspace inside Spark SQL."""
    return Shop(spark, sf_dir).after("incr").sql("""
        select b.build_id, b.mode_code, l.status_code, l.prepared_row_cnt as prepared, l.inserted_row_cnt as inserted, l.updated_row_cnt as updated, l.deleted_row_cnt as deleted
        from _meta.build b join (select build_id, max_by(struct(*), build_log_id) as l from _meta.build_log group by build_id) last on last.build_id = b.build_id
        lateral view inline(array(last.l)) l""")


@query("engine_relay", f"SELECT o_orderstatus, is_active, count(*) AS n, max(build_id) AS newest FROM ({history_sql('init')}) WHERE end_build_id IS NULL GROUP BY o_orderstatus, is_active")
def engine_relay(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Shop(spark, sf_dir).after("init").sql("select o_orderstatus, is_active, count(*) as n, max(build_id) as newest from shop.bill where end_build_id is null group by o_orderstatus, is_active")


def conducted(spark: SparkSession, sf_dir: str) -> Shop:
    """Three flows over bills and what is sent: S0, S1 by its preset, S1 again with exports skipped."""
    shop = Shop(spark, sf_dir)
    for text in (SENT, SENT_SPEC, "create flow_spec by_hand as $$select 'shop.bill' as dataset, 1 as num, 'by_customer' as mode$$"):
        shop.engine.sql(text)
    shop.deliver(first_slice)
    shop.flow()
    shop.deliver(second_slice)
    shop.flow("flow('by_hand')")
    shop.flow("flow(export = skip)")
    return shop


STEPS = "(1, 1, 'shop.bill', 'initial'), (2, 1, 'shop.sent', 'increment'), (3, 2, 'shop.bill', 'by_customer'), (4, 2, 'shop.bill', 'increment'), (5, 2, 'shop.sent', 'increment'), (6, 3, 'shop.bill', 'increment'), (7, 3, 'shop.sent', 'skip')"


@query("engine_flow_steps", f"SELECT CAST(b AS BIGINT) AS build_id, CAST(f AS BIGINT) AS flow_id, d AS dataset_code, m AS mode_code FROM (VALUES {STEPS}) t(b, f, d, m)")
def engine_flow_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conducted(spark, sf_dir).engine.sql("select build_id, flow_id, dataset_code, mode_code from _meta.build")


@query(
    "engine_mart",
    f"""WITH {BASE}, d AS ({changed_sql('sect')})
    SELECT o_custkey, o_orderkey, CAST(2 AS BIGINT) AS build_id, CAST(NULL AS BIGINT) AS end_build_id, is_active, price, o_orderstatus FROM s0
    UNION ALL SELECT o_custkey, o_orderkey, 5, NULL, is_active, price, o_orderstatus FROM d WHERE is_active""",
    "price",
)
def engine_mart(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conducted(spark, sf_dir).engine.table("shop.sent").select("o_custkey", "o_orderkey", "build_id", F.col("end_build_id").cast("long").alias("end_build_id"), "is_active", "price", "o_orderstatus")


#: The attributes of bills under the versions of their creation, of a spec, of two comments and of the spec's replacement.
ATTRS = "(1, 'o_custkey', 'bigint'), (2, 'o_orderkey', 'bigint'), (3, 'price', 'numeric(18,2)'), (4, 'o_orderstatus', 'text')"


@query(
    "full_set_copy",
    f"""SELECT CAST(v AS BIGINT) AS version_id, CAST(n AS INTEGER) AS order_num, a AS attr_code, t AS type_code,
        CASE WHEN v >= 4 AND a = 'price' THEN 'in full' END AS descr FROM (VALUES {ATTRS}) x(n, a, t), (VALUES (2), (3), (4), (5), (6)) y(v)""",
)
def full_set_copy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every command on a dataset copies all of its attributes under a new version."""
    engine = Shop(spark, sf_dir).engine  # versions 2 and 3: the dataset and its spec
    engine.sql("comment on attr shop.bill.price is 'in full'")
    engine.sql("comment on dataset shop.bill is 'bills'")
    engine.sql(BILL_SPEC.format(view="bills").replace("create", "create or replace"))
    return engine.sql("select version_id, order_num, attr_code, type_code, descr from _meta.dataset_attr")
