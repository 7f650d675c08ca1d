"""Queries of the data plane and the journals over the driver's tables, with their SQL.

States of a store are derived from ``orders``: S0 is the first build (keys that 10 does
not divide), S1 the landed slice of the second one (last digits 0, 1, 2; prices raised by
one where 7 divides the key, inactive where 11 does). ``events`` plays the catalog and
the journal: a user is an object, an event's id its version or place.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.expressions import chunk_number
from .operators import history as H
from .operators import transfer as T
from .plans import graph, journal

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

ORDERS = T.Shape(("o_custkey", "o_orderkey"), ("price", "o_orderstatus"), "o_custkey")
LINES = T.Shape(("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"), ("price", "l_linestatus"), "l_orderkey")

#: The same states in SQL.
BASE = """
    o AS (SELECT o_custkey, o_orderkey, CAST(o_totalprice AS DECIMAL(18,2)) AS price, o_orderstatus FROM orders),
    s0 AS (SELECT o_custkey, o_orderkey, price, o_orderstatus, true AS is_active FROM o WHERE o_orderkey % 10 <> 0),
    s1 AS (SELECT o_custkey, o_orderkey,
                  CAST(price + CASE WHEN o_orderkey % 7 = 0 THEN 1 ELSE 0 END AS DECIMAL(18,2)) AS price,
                  o_orderstatus, o_orderkey % 11 <> 0 AS is_active
           FROM o WHERE o_orderkey % 10 IN (0, 1, 2))
"""
CHANGED = """
    SELECT coalesce(s.o_custkey, t.o_custkey) AS o_custkey, coalesce(s.o_orderkey, t.o_orderkey) AS o_orderkey,
           coalesce(s.is_active, false) AS is_active,
           CASE WHEN s.is_active THEN s.price ELSE t.price END AS price,
           CASE WHEN s.is_active THEN s.o_orderstatus ELSE t.o_orderstatus END AS o_orderstatus,
           CAST(coalesce(s.is_active, false) AND NOT coalesce(t.is_active, false) AS INTEGER) AS inserted,
           CAST(coalesce(s.is_active, false) AND coalesce(t.is_active, false) AS INTEGER) AS updated,
           CAST(NOT coalesce(s.is_active, false) AND coalesce(t.is_active, false) AS INTEGER) AS deleted
    FROM s1 s {join} JOIN {target} t ON s.o_custkey = t.o_custkey AND s.o_orderkey = t.o_orderkey
    WHERE coalesce(s.is_active, false) <> coalesce(t.is_active, false)
       OR (s.is_active AND (s.price IS DISTINCT FROM t.price OR s.o_orderstatus IS DISTINCT FROM t.o_orderstatus))
"""
TARGETS = {"init": ("FULL", "s0"), "incr": ("LEFT", "s0"), "sect": ("FULL", "(SELECT * FROM s0 WHERE o_custkey IN (SELECT o_custkey FROM s1))")}


def changed_sql(kind: str) -> str:
    join, target = TARGETS[kind]
    return CHANGED.format(join=join, target=target)


def query(name: str, sql: str | None = None, money: str | None = None) -> Callable[[Query], Query]:
    """Register a query and its SQL. A decimal column ``money`` is returned as a double by both."""

    def register(f: Query) -> Query:
        QUERIES[name] = f if money is None else lambda spark, sf_dir: (df := f(spark, sf_dir)).withColumn(money, df[money].cast("double"))
        if sql is not None:
            ORACLES[name] = sql if money is None else f"SELECT * REPLACE (CAST({money} AS DOUBLE) AS {money}) FROM ({sql})"
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.select("o_custkey", "o_orderkey", F.col("o_totalprice").cast("decimal(18,2)").alias("price"), "o_orderstatus")


def first_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orders(spark, sf_dir).filter("o_orderkey % 10 <> 0").withColumn("is_active", F.lit(True))


def second_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    raised = (F.col("price") + F.when(F.col("o_orderkey") % 7 == 0, 1).otherwise(0)).cast("decimal(18,2)")
    return orders(spark, sf_dir).filter("o_orderkey % 10 IN (0, 1, 2)").select("o_custkey", "o_orderkey", raised.alias("price"), "o_orderstatus", (F.col("o_orderkey") % 11 != 0).alias("is_active"))


def first_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.as_versions(T.bulk(first_slice(spark, sf_dir), ORDERS), 1, ORDERS)


def second_result(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    return T.transfer("store", kind, second_slice(spark, sf_dir), first_log(spark, sf_dir), False, ORDERS)


def second_log(spark: SparkSession, sf_dir: str, kind: str = "init") -> DataFrame:
    return first_log(spark, sf_dir).unionByName(T.as_versions(second_result(spark, sf_dir, kind), 2, ORDERS))


def history_sql(kind: str) -> str:
    return f"""WITH {BASE}, d AS ({changed_sql(kind)})
        SELECT s0.o_custkey, s0.o_orderkey, CAST(1 AS BIGINT) AS build_id,
               CASE WHEN d.o_orderkey IS NOT NULL THEN CAST(1 AS BIGINT) END AS end_build_id, s0.is_active, s0.price, s0.o_orderstatus
        FROM s0 LEFT JOIN d ON s0.o_custkey = d.o_custkey AND s0.o_orderkey = d.o_orderkey
        UNION ALL
        SELECT o_custkey, o_orderkey, 2, NULL, is_active, price, o_orderstatus FROM d"""


# 2.A: landing and checks.


@query("iface_prepared_count", f"WITH {BASE} SELECT count(*) AS prepared_row_cnt FROM s1")
def iface_prepared_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return second_slice(spark, sf_dir).agg(F.count("*").alias("prepared_row_cnt"))


@query("null_key_count", "SELECT count(*) AS null_keys FROM orders WHERE o_orderkey % 100 = 0")
def null_key_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    shape = T.Shape(("k",), ("o_orderstatus",))
    slice_ = table(spark, sf_dir, "orders").select(F.expr("nullif(o_orderkey % 100, 0)").alias("k"), "o_orderstatus", F.lit(True).alias("is_active"))
    return T.null_key_count(slice_, shape)


@query("duplicate_key_count", "SELECT count(*) - count(DISTINCT (l_orderkey, l_linenumber)) AS duplicates FROM lineitem")
def duplicate_key_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    slice_ = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.lit(True).alias("is_active"))
    return T.duplicate_key_count(slice_, T.Shape(("l_orderkey", "l_linenumber"), ()))


@query("target_is_empty", "SELECT NOT EXISTS (SELECT 1 FROM orders) AS orders_empty, NOT EXISTS (SELECT 1 FROM orders WHERE o_orderkey < 0) AS none_empty")
def target_is_empty(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    probe = lambda df, name: df.limit(1).agg((F.count("*") == 0).alias(name))
    return probe(o, "orders_empty").crossJoin(probe(o.filter("o_orderkey < 0"), "none_empty"))


def repeated_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines by (order, line number), which repeats; flags true, false and null."""
    flag = F.when(F.col("l_partkey") % 5 == 0, None).otherwise(F.col("l_partkey") % 3 != 0)
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", flag.alias("is_active"), "l_partkey", "l_suppkey")


@query(
    "slice_dedup",
    """WITH s AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_partkey % 5 = 0 THEN NULL ELSE l_partkey % 3 <> 0 END AS is_active, l_partkey, l_suppkey FROM lineitem)
       SELECT DISTINCT ON (l_orderkey, l_linenumber) * FROM s
       ORDER BY l_orderkey, l_linenumber, is_active DESC NULLS FIRST, l_partkey, l_suppkey""",
)
def slice_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.one_per_key(repeated_slice(spark, sf_dir), T.Shape(("l_orderkey", "l_linenumber"), ("l_partkey", "l_suppkey")))


@query("not_null_check", f"WITH {BASE} SELECT o_custkey, o_orderkey, nullif(o_orderstatus, 'F') AS o_orderstatus FROM s1 WHERE is_active AND o_orderstatus = 'F'")
def not_null_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    slice_ = second_slice(spark, sf_dir).withColumn("o_orderstatus", F.expr("nullif(o_orderstatus, 'F')"))
    return T.missing_values(slice_, ORDERS).select("o_custkey", "o_orderkey", "o_orderstatus")


@query("section_narrow", f"WITH {BASE} SELECT * FROM s0 WHERE o_custkey IN (SELECT o_custkey FROM s1)", "price")
def section_narrow(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.narrowed(first_slice(spark, sf_dir), second_slice(spark, sf_dir), T.SECT, ORDERS)


@query("chunk_balance", "SELECT count(*) AS n, CAST(4 AS BIGINT) AS chunks FROM orders")
def chunk_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    numbered = table(spark, sf_dir, "orders").select(chunk_number(F.col("o_custkey"), 4).alias("rn")).filter("rn BETWEEN 1 AND 4")
    return numbered.groupBy("rn").agg(F.count("*").alias("n")).agg(F.sum("n").alias("n"), F.count("*").alias("chunks"))


# 2.A: merges and history.


@query("open_target", f"SELECT * EXCLUDE (end_build_id, build_id) FROM ({history_sql('init')}) WHERE end_build_id IS NULL", "price")
def open_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.open_versions(second_log(spark, sf_dir), ORDERS).drop("build_id")


def _merge_history(kind: str) -> Query:
    return lambda spark, sf_dir: H.store_history(second_log(spark, sf_dir, kind), ORDERS)


for _kind in ("init", "incr", "sect"):
    query(f"scd2_merge_{_kind}", history_sql(_kind), "price")(_merge_history(_kind))
    query(f"scd2_changed_rows_{_kind}", f"WITH {BASE} {changed_sql(_kind)}", "price")(lambda spark, sf_dir, kind=_kind: second_result(spark, sf_dir, kind))
    query(
        f"scd2_stats_{_kind}",
        f"""WITH {BASE}, d AS ({changed_sql(_kind)}) SELECT coalesce(sum(inserted), 0)::BIGINT AS inserted_row_cnt,
            coalesce(sum(updated), 0)::BIGINT AS updated_row_cnt, coalesce(sum(deleted), 0)::BIGINT AS deleted_row_cnt FROM d""",
    )(lambda spark, sf_dir, kind=_kind: T.statistics(second_result(spark, sf_dir, kind)))


@query(
    "scd2_revival",
    f"""WITH {BASE}, d AS ({changed_sql("init")}), t AS (SELECT * FROM d WHERE NOT is_active)
        SELECT o.o_custkey, o.o_orderkey, true AS is_active, o.price, o.o_orderstatus, 1 AS inserted, 0 AS updated, 0 AS deleted
        FROM o JOIN t USING (o_custkey, o_orderkey) WHERE o.o_orderkey % 11 = 0""",
    "price",
)
def scd2_revival(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The third build lands keys that the second one deleted: they count as inserted."""
    again = orders(spark, sf_dir).filter("o_orderkey % 11 = 0").withColumn("is_active", F.lit(True))
    log = second_log(spark, sf_dir)
    dead = T.open_versions(log, ORDERS).filter(~F.col("is_active")).select(*ORDERS.key)
    return T.merge(again.join(dead, list(ORDERS.key), "left_semi"), log, T.INCR, ORDERS)


@query("bulk_insert_active", f"WITH {BASE} SELECT o_custkey, o_orderkey, CAST(1 AS BIGINT) AS build_id, is_active, price, o_orderstatus FROM s1 WHERE is_active", "price")
def bulk_insert_active(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.as_versions(T.transfer("store", T.INIT, second_slice(spark, sf_dir), first_log(spark, sf_dir).limit(0), True, ORDERS), 1, ORDERS)


def portions(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    second = T.transfer("mart", kind, second_slice(spark, sf_dir), first_log(spark, sf_dir), False, ORDERS)
    return first_log(spark, sf_dir).unionByName(T.as_versions(second, 2, ORDERS))


def portions_sql(first_end: str, second: str = "SELECT o_custkey, o_orderkey, 2, NULL, is_active, price, o_orderstatus FROM s1 WHERE is_active") -> str:
    return f"""WITH {BASE} SELECT o_custkey, o_orderkey, CAST(1 AS BIGINT) AS build_id, CAST({first_end} AS BIGINT) AS end_build_id, is_active, price, o_orderstatus
        FROM s0 {"UNION ALL " + second if second else ""}"""


@query("mart_append_portions", portions_sql("NULL"), "price")
def mart_append_portions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.mart_history(portions(spark, sf_dir, T.APPD), ORDERS, [])


@query("mart_full_resend", portions_sql("1"), "price")
def mart_full_resend(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.mart_history(portions(spark, sf_dir, T.INIT), ORDERS, [2])


@query("mart_skip", portions_sql("NULL", ""), "price")
def mart_skip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.mart_history(portions(spark, sf_dir, T.SKIP), ORDERS, [])


@query("dataset_view_union", f"{history_sql('init')} UNION ALL SELECT o_custkey, o_orderkey, CAST(1 AS BIGINT), NULL, is_active, price, o_orderstatus FROM s0", "price")
def dataset_view_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.dataset_view([H.store_history(second_log(spark, sf_dir), ORDERS), H.store_history(first_log(spark, sf_dir), ORDERS)])


@query("empty_typed_view", "SELECT ''::VARCHAR AS num, 0::BIGINT AS build_id, 0::BIGINT AS end_build_id, true AS is_active, 0::INTEGER AS val WHERE false")
def empty_typed_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.empty_history(spark, [("num", "text", True), ("val", "integer", False)])


@query("as_of_first", f"SELECT * FROM ({history_sql('init')}) WHERE build_id <= 1 AND (end_build_id IS NULL OR end_build_id >= 1)", "price")
def as_of_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.as_of(H.store_history(second_log(spark, sf_dir), ORDERS), 1)


@query("as_of_second", f"SELECT * FROM ({history_sql('init')}) WHERE build_id <= 2 AND (end_build_id IS NULL OR end_build_id >= 2)", "price")
def as_of_second(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.as_of(H.store_history(second_log(spark, sf_dir), ORDERS), 2)


@query("delta_window_slice", f"SELECT * FROM ({history_sql('incr')}) WHERE build_id > 1 AND build_id <= 2 AND end_build_id IS NULL AND is_active", "price")
def delta_window_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.delta(H.store_history(second_log(spark, sf_dir, "incr"), ORDERS), 1, 2)


LINE_SLICES = """
    l AS (SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, CAST(l_extendedprice AS DECIMAL(18,2)) AS price, l_linestatus FROM lineitem),
    b AS (SELECT * FROM l WHERE l_orderkey % 10 <> 0),
    n AS (SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, CAST(price + CASE WHEN l_partkey % 7 = 0 THEN 1 ELSE 0 END AS DECIMAL(18,2)) AS price, l_linestatus,
                 l_partkey % 11 <> 0 AS is_active FROM l WHERE l_orderkey % 10 IN (0, 1))
"""


@query(
    "scd2_lines_incr_stats",
    f"""WITH {LINE_SLICES}, d AS (SELECT coalesce(n.is_active, false) AS act, b.l_orderkey IS NOT NULL AS was FROM n LEFT JOIN b
            ON n.l_orderkey = b.l_orderkey AND n.l_partkey = b.l_partkey AND n.l_suppkey = b.l_suppkey AND n.l_linenumber = b.l_linenumber
        WHERE n.is_active <> (b.l_orderkey IS NOT NULL) OR (n.is_active AND (n.price IS DISTINCT FROM b.price OR n.l_linestatus IS DISTINCT FROM b.l_linestatus)))
        SELECT count(*) FILTER (WHERE act AND NOT was) AS inserted_row_cnt, count(*) FILTER (WHERE act AND was) AS updated_row_cnt,
               count(*) FILTER (WHERE NOT act AND was) AS deleted_row_cnt FROM d""",
)
def scd2_lines_incr_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", F.col("l_extendedprice").cast("decimal(18,2)").alias("price"), "l_linestatus")
    log = lines.filter("l_orderkey % 10 <> 0").select(*LINES.key, F.lit(1).cast("long").alias("build_id"), F.lit(True).alias("is_active"), *LINES.rest)
    raised = (F.col("price") + F.when(F.col("l_partkey") % 7 == 0, 1).otherwise(0)).cast("decimal(18,2)")
    slice_ = lines.filter("l_orderkey % 10 IN (0, 1)").withColumn("price", raised).withColumn("is_active", F.col("l_partkey") % 11 != 0)
    return T.statistics(T.merge(slice_, log, T.INCR, LINES))


# 2.B: catalog and journal, played by events.

EVENT = "SELECT user_id, event_id, event_type, value FROM events"
LAST = "SELECT user_id, arg_max(event_type, event_id) AS status_code, max(event_id) AS event_id FROM events GROUP BY user_id"


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "value")


def as_log(spark: SparkSession, sf_dir: str, run: str = "build_id") -> DataFrame:
    return events(spark, sf_dir).select(F.col("user_id").alias(run), F.col("event_id").alias(f"{run[:-3]}_log_id"), F.col("event_type").alias("status_code"))


@query("latest_version", "SELECT DISTINCT ON (user_id) * FROM (" + EVENT + ") ORDER BY user_id, event_id DESC")
def latest_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    return journal.newest(events(spark, sf_dir), ["user_id"], "event_id")


@query("latest_version_of_one", EVENT + " WHERE user_id = (SELECT min(user_id) FROM events) ORDER BY event_id DESC LIMIT 1")
def latest_version_of_one(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir)
    own = e.join(F.broadcast(e.agg(F.min("user_id").alias("user_id"))), "user_id", "left_semi")
    return journal.newest_of(own, F.lit(True), "event_id")


@query("live_objects", f"SELECT * FROM (SELECT DISTINCT ON (user_id) * FROM ({EVENT}) ORDER BY user_id, event_id DESC) WHERE event_type <> 'error'")
def live_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir).withColumn("is_deleted", F.col("event_type") == "error")
    return journal.live(e, ["user_id"], "event_id").drop("is_deleted")


@query("last_status", LAST)
def last_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return journal.last_status(events(spark, sf_dir).withColumnRenamed("event_type", "status_code"), "user_id", "event_id")


def as_builds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A build per user: its dataset, mode and flow follow from the user's number."""
    mode = F.element_at(F.array(*[F.lit(m) for m in ("initial", "increment", "repair")]), (F.col("user_id") % 3 + 1).cast("int"))
    return events(spark, sf_dir).select("user_id").distinct().select(
        F.col("user_id").alias("build_id"), (F.col("user_id") % 5).alias("flow_id"), F.concat(F.lit("dm.d"), F.col("user_id") % 7).alias("dataset_code"), (F.col("user_id") % 2 + 1).cast("int").alias("build_spec_num"), mode.alias("mode_code")
    )


def as_journal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as journal rows: purchases are ``done``, errors ``fail``, signups ``fix``, others ``load``."""
    status = F.when(F.col("event_type") == "purchase", "done").when(F.col("event_type") == "error", "fail").when(F.col("event_type") == "signup", "fix").otherwise("load")
    return events(spark, sf_dir).select(F.col("user_id").alias("build_id"), F.col("event_id").alias("build_log_id"), status.alias("status_code"))


BUILDS = """
    b AS (SELECT DISTINCT user_id AS build_id, user_id % 5 AS flow_id, 'dm.d' || (user_id % 7) AS dataset_code, CAST(user_id % 2 + 1 AS INTEGER) AS build_spec_num,
                 ['initial', 'increment', 'repair'][CAST(user_id % 3 + 1 AS INTEGER)] AS mode_code FROM events),
    j AS (SELECT user_id AS build_id, arg_max(CASE event_type WHEN 'purchase' THEN 'done' WHEN 'error' THEN 'fail' WHEN 'signup' THEN 'fix' ELSE 'load' END, event_id) AS status_code
          FROM events GROUP BY user_id)
"""


@query("open_objects", f"WITH {BUILDS} SELECT build_id, status_code FROM b JOIN j USING (build_id) WHERE status_code NOT IN ('done', 'fix') AND dataset_code = 'dm.d3' AND build_spec_num = 1 ORDER BY build_id LIMIT 1")
def open_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return journal.open_build(as_builds(spark, sf_dir), as_journal(spark, sf_dir), "dm.d3", 1)


@query("busy_sources", f"WITH {BUILDS} SELECT build_id, dataset_code, status_code FROM b JOIN j USING (build_id) WHERE status_code NOT IN ('done', 'fix') AND dataset_code IN ('dm.d1', 'dm.d2')")
def busy_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return journal.busy_sources(as_builds(spark, sf_dir), as_journal(spark, sf_dir), ["dm.d1", "dm.d2"])


def as_specs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Versions of specs by (user modulo 7, modulo 2); an error is a tombstone."""
    return events(spark, sf_dir).select(
        F.concat(F.lit("dm.d"), F.col("user_id") % 7).alias("dataset_code"), (F.col("user_id") % 2 + 1).cast("int").alias("build_spec_num"), F.col("event_id").alias("version_id"), (F.col("event_type") == "error").alias("is_deleted")
    )


def as_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_specs(spark, sf_dir).select("dataset_code", "build_spec_num", "version_id", F.explode(F.array(F.concat(F.lit("dm.d"), F.col("version_id") % 7), F.lit("dm.base"))).alias("source_dataset_code"))


SPECS = """
    v AS (SELECT 'dm.d' || (user_id % 7) AS dataset_code, CAST(user_id % 2 + 1 AS INTEGER) AS build_spec_num, event_id AS version_id, event_type = 'error' AS is_deleted FROM events),
    c AS (SELECT * FROM (SELECT DISTINCT ON (dataset_code, build_spec_num) * FROM v ORDER BY dataset_code, build_spec_num, version_id DESC) WHERE NOT is_deleted),
    e AS (SELECT dataset_code, build_spec_num, unnest(['dm.d' || (version_id % 7), 'dm.base']) AS source_dataset_code FROM c)
"""


@query("live_edges", f"WITH {SPECS} SELECT * FROM e")
def live_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return journal.live_edges(as_specs(spark, sf_dir), as_sources(spark, sf_dir))


@query("reader_specs", f"WITH {SPECS} SELECT dataset_code, build_spec_num FROM e WHERE source_dataset_code = 'dm.base'")
def reader_specs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return journal.reader_specs(as_specs(spark, sf_dir), as_sources(spark, sf_dir), "dm.base")


@query("active_readers", f"WITH {SPECS}, {BUILDS} SELECT build_id, dataset_code, status_code FROM b JOIN j USING (build_id) WHERE status_code IN ('wait', 'load', 'comp') AND (dataset_code, build_spec_num) IN (SELECT (dataset_code, build_spec_num) FROM e WHERE source_dataset_code = 'dm.base')")
def active_readers(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = journal.live_edges(as_specs(spark, sf_dir), as_sources(spark, sf_dir))
    return journal.active_readers(as_builds(spark, sf_dir), as_journal(spark, sf_dir), edges, "dm.base")


@query("mode_sets", f"WITH {SPECS} SELECT dataset_code, build_spec_num, array_to_string(list_sort(['initial', CASE WHEN version_id % 2 = 0 THEN 'increment' ELSE 'by_hand' END]), ',') AS modes FROM c")
def mode_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    specs = as_specs(spark, sf_dir)
    modes = specs.select("dataset_code", "build_spec_num", "version_id", F.explode(F.array(F.lit("initial"), F.when(F.col("version_id") % 2 == 0, "increment").otherwise("by_hand"))).alias("mode_code"))
    return journal.mode_sets(specs, modes).withColumn("modes", F.array_join("modes", ","))


@query("specs_with_window", f"WITH {BUILDS} SELECT DISTINCT dataset_code, build_spec_num FROM b JOIN j USING (build_id) WHERE status_code = 'done' AND mode_code IN ('initial', 'increment', 'skip')")
def specs_with_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return journal.with_window(as_builds(spark, sf_dir), as_journal(spark, sf_dir))


@query("window_from", f"""WITH {BUILDS}, t AS (SELECT user_id AS build_id, arg_max(ts, event_id) AS log_time FROM events GROUP BY 1)
    SELECT coalesce(max(build_id), 0)::BIGINT AS from_build_id, arg_max(log_time, build_id) AS previous_time FROM b JOIN j USING (build_id) JOIN t USING (build_id)
    WHERE status_code = 'done' AND mode_code IN ('initial', 'increment', 'skip') AND dataset_code = 'dm.d3' AND build_spec_num = 2""")
def window_from(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = as_journal(spark, sf_dir).join(table(spark, sf_dir, "events").select(F.col("event_id").alias("build_log_id"), F.col("ts").alias("log_time")), "build_log_id")
    return journal.window_from(as_builds(spark, sf_dir), log, "dm.d3", 2)


def as_flow_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.when(F.col("event_type") == "purchase", "done").when(F.col("event_type") == "error", "stop").when(F.col("event_type") == "signup", "hold").otherwise("exec")
    return events(spark, sf_dir).select((F.col("user_id") % 97).alias("flow_id"), F.col("event_id").alias("flow_log_id"), status.alias("status_code"))


FLOWS = """f AS (SELECT user_id % 97 AS flow_id, max(event_id) AS flow_log_id,
    arg_max(CASE event_type WHEN 'purchase' THEN 'done' WHEN 'error' THEN 'stop' WHEN 'signup' THEN 'hold' ELSE 'exec' END, event_id) AS status_code FROM events GROUP BY 1)"""


@query("window_to_manual", f"WITH {BUILDS}, {FLOWS} SELECT coalesce(max(build_id), 0)::BIGINT AS to_build_id FROM b WHERE build_id % 97 IN (SELECT flow_id FROM f WHERE status_code = 'done')")
def window_to_manual(spark: SparkSession, sf_dir: str) -> DataFrame:
    return journal.window_to_manual(as_builds(spark, sf_dir).withColumn("flow_id", F.col("build_id") % 97), as_flow_log(spark, sf_dir))


@query("open_flows_ahead", f"WITH {FLOWS} SELECT flow_id, status_code, flow_log_id FROM f WHERE status_code IN ('wait', 'exec', 'hold') AND flow_id < 50")
def open_flows_ahead(spark: SparkSession, sf_dir: str) -> DataFrame:
    return journal.open_flows(as_flow_log(spark, sf_dir), 50)


@query("journal_tail", EVENT + " WHERE event_id > 5000 ORDER BY event_id")
def journal_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    return journal.tail(events(spark, sf_dir), "event_id", 5000)


@query("next_id", "SELECT (coalesce(max(event_id), 0) + 1)::BIGINT AS next_id FROM events")
def next_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return journal.next_id(events(spark, sf_dir), "event_id")


# 2.D: order and plan of a small graph, and the relay.

LIBRARY = [
    graph.LiveSpec("lib.shelf", 1, "store", frozenset({"initial", "increment", "by_branch"}), has_window=True),
    graph.LiveSpec("lib.loan", 1, "store", frozenset({"initial", "increment"}), frozenset({"lib.shelf"}), has_window=True),
    graph.LiveSpec("lib.loan", 2, "store", frozenset({"initial"})),
    graph.LiveSpec("lib.rate", 1, "store", frozenset({"initial"})),
    graph.LiveSpec("lib.fine", 1, "store", frozenset({"initial", "increment"}), frozenset({"lib.loan", "lib.rate"})),
    graph.LiveSpec("out.label", 1, "mart", frozenset({"increment", "skip"}), frozenset({"lib.shelf"})),
    graph.LiveSpec("out.letter", 1, "mart", frozenset({"initial", "increment", "skip"}), frozenset({"lib.fine"})),
]


@query("topo_order", "SELECT * FROM (VALUES (1, 'lib.rate'), (2, 'lib.shelf'), (3, 'lib.loan'), (4, 'lib.fine'), (5, 'out.label'), (6, 'out.letter')) t(place, dataset_code)")
def topo_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges: dict[str, set[str]] = {}
    for s in LIBRARY:
        edges.setdefault(s.dataset, set()).update(s.sources)
    return spark.createDataFrame(list(enumerate(graph.order(set(edges), edges), 1)), "place int, dataset_code string")


@query("flow_plan", "SELECT * FROM (VALUES (1, 'lib.rate', 1, 'initial'), (2, 'lib.shelf', 1, 'increment'), (3, 'lib.loan', 1, 'increment'), (4, 'lib.loan', 2, 'initial'), (5, 'lib.fine', 1, 'initial'), (6, 'out.label', 1, 'increment'), (7, 'out.letter', 1, 'increment')) t(place, dataset_code, num, mode_code)")
def flow_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [(n, s.dataset, s.num, s.mode) for n, s in enumerate(graph.plan_flow(LIBRARY, {}), 1)]
    return spark.createDataFrame(rows, "place int, dataset_code string, num int, mode_code string")


RELAY = """SELECT l_returnflag, l_linestatus, count(*) AS n, sum(CAST(l_quantity AS DECIMAL(18,2))) AS quantity, min(l_shipdate) AS first_ship
    FROM lineitem WHERE l_shipdate <= TIMESTAMP{ntz} '1998-09-02 00:00:00' GROUP BY l_returnflag, l_linestatus"""


@query("relay_sql", RELAY.format(ntz=""), "quantity")
def relay_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    table(spark, sf_dir, "lineitem").createOrReplaceTempView("relayed_lineitem")
    return spark.sql(RELAY.format(ntz="_NTZ").replace("FROM lineitem", "FROM relayed_lineitem"))

