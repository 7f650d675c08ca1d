"""Reading history: closed intervals, views over specs, as-of slices, delta windows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.types import spark_type
from .transfer import Shape, open_versions, with_next


def columns(shape: Shape) -> list[str]:
    return [*shape.key, "build_id", "end_build_id", "is_active", *shape.rest]


def store_history(log: DataFrame, shape: Shape) -> DataFrame:
    """A store's versions with ``end_build_id``: inclusive, null while open.

    A merge adds a version of a key if and only if it displaces the open one, so a
    version ends right before the next one of its key.
    """
    return with_next(log, shape).withColumn("end_build_id", F.col("next_build_id") - 1).select(*columns(shape))


def mart_history(log: DataFrame, shape: Shape, resends: list[int]) -> DataFrame:
    """A mart's portions; every full resend (builds ``resends``) ends all older ones.

    ``resends`` comes from the journal, a number per such build; nothing is shuffled.
    """
    later = F.filter(F.array(*[F.lit(b) for b in resends]).cast("array<bigint>"), lambda b: b > F.col("build_id"))
    return log.withColumn("end_build_id", F.array_min(later) - 1).select(*columns(shape))


def empty_history(spark: SparkSession, attrs: list[tuple[str, str, bool]]) -> DataFrame:
    """The typed empty relation of a dataset without specs; attrs: (name, type code, in key)."""
    typed = [T.StructField(n, spark_type(c)) for n, c, _ in attrs]
    key = [f for f, (_, _, k) in zip(typed, attrs, strict=True) if k]
    rest = [f for f, (_, _, k) in zip(typed, attrs, strict=True) if not k]
    own = [T.StructField("build_id", T.LongType()), T.StructField("end_build_id", T.LongType()), T.StructField("is_active", T.BooleanType())]
    return spark.createDataFrame([], T.StructType([*key, *own, *rest]))


def dataset_view(parts: list[DataFrame]) -> DataFrame:
    """UNION ALL of the histories of a dataset's live specs, in order of their numbers."""
    return reduce(DataFrame.unionByName, parts)


def as_of(history: DataFrame, build_id: int) -> DataFrame:
    """Versions, tombstones too, that were open when ``build_id`` was the newest build."""
    return history.filter((F.col("build_id") <= build_id) & (F.col("end_build_id").isNull() | (F.col("end_build_id") >= build_id)))


def delta(history: DataFrame, from_build_id: int, to_build_id: int, current: bool = True) -> DataFrame:
    """Versions of builds in (from, to]; with ``current``, open and active ones only."""
    window = history.filter((F.col("build_id") > from_build_id) & (F.col("build_id") <= to_build_id))
    return window.filter(F.col("end_build_id").isNull() & F.col("is_active")) if current else window


def store_current(log: DataFrame, shape: Shape) -> DataFrame:
    """``store_history`` where ``end_build_id`` is null: the newest version of each key, without a window."""
    return open_versions(log, shape).withColumn("end_build_id", F.lit(None).cast("long")).select(*columns(shape))


def store_as_of(log: DataFrame, shape: Shape, build_id: int) -> DataFrame:
    """``as_of`` of a store's history from its log.

    The versions come from builds up to ``build_id`` only, by an aggregate; later builds
    give no more than the build that ended a version.
    """
    shown = open_versions(log.filter(F.col("build_id") <= build_id), shape)
    ended = log.filter(F.col("build_id") > build_id).groupBy(*shape.key).agg((F.min("build_id") - 1).alias("end_build_id"))
    return shown.join(ended, list(shape.key), "left").select(*columns(shape))


def store_delta(log: DataFrame, shape: Shape, from_build_id: int, to_build_id: int, current: bool = True) -> DataFrame:
    """``delta`` of a store's history from its log.

    What ends a version is younger than it, so builds up to ``from_build_id`` aren't read;
    the filter lies below the aggregate or window, where it prunes folders.
    """
    later = log.filter(F.col("build_id") > from_build_id)
    if current:
        return store_current(later, shape).filter((F.col("build_id") <= to_build_id) & F.col("is_active"))
    return store_history(later, shape).filter(F.col("build_id") <= to_build_id)
