"""Queries over the versioned catalog and the journals, as DataFrame plans.

"Newest of each" is an aggregate with ``max_by``: it has a partial stage, so each task
sends one row per object, where a window would shuffle and sort the whole journal.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .graph import CLEAN

FINAL = ("done", "fix")
RUNNING = ("wait", "load", "comp")
OPEN_FLOW = ("wait", "exec", "hold")


def newest(df: DataFrame, keys: list[str], by: str) -> DataFrame:
    """Per key, the row with the highest ``by``."""
    rest = [c for c in df.columns if c not in keys]
    row = F.max_by(F.struct(*rest), by).alias("row")
    return df.groupBy(*keys).agg(row).select(*keys, "row.*")


def newest_of(df: DataFrame, condition: Column, by: str) -> DataFrame:
    """The newest version of one object: a top-1, not a sort."""
    return df.filter(condition).orderBy(F.desc(by)).limit(1)


def live(df: DataFrame, keys: list[str], by: str = "version_id", deleted: str = "is_deleted") -> DataFrame:
    """Newest versions without tombstones."""
    return newest(df, keys, by).filter(~F.col(deleted))


def last_status(log: DataFrame, run: str, position: str) -> DataFrame:
    """Per run: its last status and where the journal has it."""
    return log.groupBy(run).agg(F.max_by("status_code", position).alias("status_code"), F.max(position).alias(position))


def live_edges(specs: DataFrame, sources: DataFrame) -> DataFrame:
    """(reader, source) of live specs."""
    keys = ["dataset_code", "build_spec_num"]
    current = live(specs, keys).select(*keys, "version_id")
    return current.join(sources, [*keys, "version_id"]).select("dataset_code", "build_spec_num", "source_dataset_code")


def reader_specs(specs: DataFrame, sources: DataFrame, dataset: str) -> DataFrame:
    return live_edges(specs, sources).filter(F.col("source_dataset_code") == dataset).select("dataset_code", "build_spec_num")


def mode_sets(specs: DataFrame, modes: DataFrame) -> DataFrame:
    """Modes of each live spec as a sorted array."""
    keys = ["dataset_code", "build_spec_num"]
    current = live(specs, keys).select(*keys, "version_id")
    return current.join(modes, [*keys, "version_id"]).groupBy(*keys).agg(F.sort_array(F.collect_set("mode_code")).alias("modes"))


def unfinished(builds: DataFrame, log: DataFrame, statuses: tuple[str, ...] | None = None) -> DataFrame:
    """Builds whose last status is not final, or is one of ``statuses``."""
    status = last_status(log, "build_id", "build_log_id").select("build_id", "status_code")
    keep = F.col("status_code").isin(*statuses) if statuses else ~F.col("status_code").isin(*FINAL)
    return builds.join(status, "build_id").filter(keep)


def open_build(builds: DataFrame, log: DataFrame, dataset: str, num: int) -> DataFrame:
    own = unfinished(builds, log).filter((F.col("dataset_code") == dataset) & (F.col("build_spec_num") == num))
    return own.select("build_id", "status_code").orderBy("build_id").limit(1)


def busy_sources(builds: DataFrame, log: DataFrame, sources: list[str]) -> DataFrame:
    return unfinished(builds, log).filter(F.col("dataset_code").isin(sources)).select("build_id", "dataset_code", "status_code")


def active_readers(builds: DataFrame, log: DataFrame, edges: DataFrame, dataset: str) -> DataFrame:
    readers = edges.filter(F.col("source_dataset_code") == dataset).select("dataset_code", "build_spec_num").distinct()
    return unfinished(builds, log, RUNNING).join(readers, ["dataset_code", "build_spec_num"], "left_semi").select("build_id", "dataset_code", "status_code")


def open_flows(flow_log: DataFrame, before: int | None = None) -> DataFrame:
    """Flows that wait, run or hold; with ``before``, those ahead in the queue."""
    found = last_status(flow_log, "flow_id", "flow_log_id").filter(F.col("status_code").isin(*OPEN_FLOW))
    return found.filter(F.col("flow_id") < before) if before is not None else found


def clean_done(builds: DataFrame, log: DataFrame) -> DataFrame:
    done = last_status(log, "build_id", "build_log_id").filter("status_code = 'done'").select("build_id")
    return builds.filter(F.col("mode_code").isin(*CLEAN)).join(done, "build_id", "left_semi")


def with_window(builds: DataFrame, log: DataFrame) -> DataFrame:
    """Specs of which a clean build is done."""
    return clean_done(builds, log).select("dataset_code", "build_spec_num").distinct()


def window_from(builds: DataFrame, log: DataFrame, dataset: str, num: int) -> DataFrame:
    """The lower border of a spec's delta: its last clean build that is done, and when that was; 0 and null without one."""
    own = clean_done(builds, log).filter((F.col("dataset_code") == dataset) & (F.col("build_spec_num") == num))
    ended = log.groupBy("build_id").agg(F.max_by("log_time", "build_log_id").alias("log_time"))
    last = own.join(ended, "build_id").agg(F.max(F.struct("build_id", "log_time")).alias("last"))
    return last.select(F.coalesce("last.build_id", F.lit(0)).cast("long").alias("from_build_id"), F.col("last.log_time").alias("previous_time"))


def window_to_manual(builds: DataFrame, flow_log: DataFrame) -> DataFrame:
    """The upper border of a mart that is built by hand: the last build of any done flow, else 0."""
    done = last_status(flow_log, "flow_id", "flow_log_id").filter("status_code = 'done'").select("flow_id")
    return builds.join(done, "flow_id", "left_semi").agg(F.coalesce(F.max("build_id"), F.lit(0)).cast("long").alias("to_build_id"))


def tail(log: DataFrame, position: str, after: int) -> DataFrame:
    return log.filter(F.col(position) > after).orderBy(position)


def next_id(df: DataFrame, column: str) -> DataFrame:
    return df.agg((F.coalesce(F.max(column), F.lit(0)) + 1).cast("long").alias("next_id"))
