"""Journals as they grow."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.metalog import MetaLog, schema_of

#: Statuses that end a tail.
ENDS = {"build": ("done", "fail", "fix"), "flow": ("done", "stop")}


def follow(meta: MetaLog, run: str, number: int, after: int = 0, poll: float = 1.0, wait: Callable[[float], None] = time.sleep) -> Iterator[dict]:
    """Journal rows of a build or flow past a place, until it ends.

    A place beyond the end of a finished run gives nothing, at once.
    """
    place = f"{run}_log_id"
    while True:
        meta.refresh()
        ended = meta.status(run, number) in ENDS[run]
        for row in meta.all(f"{run}_log", **{f"{run}_id": number}):
            if row[place] > after:
                after = row[place]
                yield row
        if ended:
            return
        wait(poll)


def line(row: dict) -> str:
    """A journal row as a client reads it."""
    counts = [f"{name} {row[f'{name}_row_cnt']}" for name in ("prepared", "inserted", "updated", "deleted") if row.get(f"{name}_row_cnt") is not None]
    return " | ".join(x for x in (f"{row['log_time']:%Y-%m-%d %H:%M:%S}", row["status_code"], row["message"] or "", ", ".join(counts)) if x)


def journal_stream(spark: SparkSession, log_folder: str, table: str = "build_log") -> DataFrame:
    """Rows of a journal as a stream: each commit of the metadata log is a new file."""
    commit = T.StructType([T.StructField(table, T.ArrayType(schema_of(table)))])
    files = spark.readStream.schema(commit).option("pathGlobFilter", "*.json").json(log_folder)
    return files.select(F.explode(table).alias("row")).select("row.*")


def status_counts(journal: DataFrame, window: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Journal rows per status and window of time, with a watermark for late files."""
    return journal.withWatermark("log_time", late).groupBy(F.window("log_time", window), "status_code").agg(F.count("*").alias("n"))
