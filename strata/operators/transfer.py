"""Transfer of a landed slice into SCD2 history.

A store's history is an append-only log: per version the key, ``build_id``,
``is_active`` and the other attributes. Nothing is ever updated; where a version ends
follows from the next version of its key (see ``history``). A merge compares the slice
with the open versions and returns the new versions to append.

Scale. Only keys (or sections) of the slice can change in an incremental (or sectional)
merge, so the log is semi-joined with them before any window or join: a small slice is
broadcast by the optimizer, and the log is then scanned but not shuffled. A full merge
shuffles both sides once, by key; the window over the log and the join share that
partitioning. Hot sections are no problem, as sections are joined as distinct values.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import INTERNAL_ERROR, NOT_NULL_VIOLATION, UNIQUE_VIOLATION, StrataError
from ..functions.expressions import any_null, any_of, differs

#: Transfer types. The first three are a store's, the last three a mart's.
INIT, INCR, SECT, APPD, SKIP = "init", "incr", "sect", "appd", "skip"


@dataclass(frozen=True)
class Shape:
    """Attributes of a dataset: the key, the others, and the attribute of sections."""

    key: tuple[str, ...]
    rest: tuple[str, ...]
    chunk: str | None = None

    @property
    def landed(self) -> list[str]:
        return [*self.key, "is_active", *self.rest]

    @property
    def log(self) -> list[str]:
        return [*self.key, "build_id", "is_active", *self.rest]


def null_keys(slice_: DataFrame, shape: Shape) -> DataFrame:
    """Rows, active or not, with a null in the key."""
    return slice_.filter(any_null(list(shape.key)))


def null_key_count(slice_: DataFrame, shape: Shape) -> DataFrame:
    return null_keys(slice_, shape).agg(F.count("*").alias("null_keys"))


def duplicate_key_count(slice_: DataFrame, shape: Shape) -> DataFrame:
    """How many active rows repeat the key of another one.

    Counts per key, so that no task sees more than a key's partial count; a distinct
    count over a struct would shuffle twice.
    """
    per_key = slice_.filter("is_active").groupBy(*shape.key).agg(F.count("*").alias("n"))
    return per_key.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).cast("long").alias("duplicates"))


def missing_values(slice_: DataFrame, shape: Shape) -> DataFrame:
    """Active rows without a value in some attribute outside the key."""
    return slice_.filter(F.col("is_active") & any_null(list(shape.rest)))


def one_per_key(slice_: DataFrame, shape: Shape) -> DataFrame:
    """One row per key: a null flag first, then inactive last; ties by the other attributes.

    The least row of an aggregate, not a window: partial aggregation leaves a single row
    per key and task before the shuffle, however often a key repeats.
    """
    rank = F.when(F.col("is_active").isNull(), 0).when(F.col("is_active"), 1).otherwise(2)
    row = F.struct(rank.alias("rank"), *[F.struct(F.col(c).isNull().alias("n"), F.col(c).alias("v")).alias(c) for c in shape.rest])
    best = slice_.groupBy(*shape.key).agg(F.min(row).alias("row"))
    flag = F.when(F.col("row.rank") > 0, F.col("row.rank") == 1)
    return best.select(*shape.key, flag.alias("is_active"), *[F.col(f"row.`{c}`.v").alias(c) for c in shape.rest])


def sections(slice_: DataFrame, shape: Shape) -> DataFrame:
    """Distinct values of the section attribute over all landed rows, inactive ones too."""
    return slice_.select(shape.chunk).distinct()


def open_versions(log: DataFrame, shape: Shape) -> DataFrame:
    """The newest version of each key, by an aggregate with a partial stage."""
    row = F.max_by(F.struct("build_id", "is_active", *shape.rest), "build_id")
    return log.groupBy(*shape.key).agg(row.alias("row")).select(*shape.key, "row.*")


def narrowed(log: DataFrame, slice_: DataFrame, kind: str, shape: Shape) -> DataFrame:
    """Versions that a transfer of this kind can touch; keys never cross this border."""
    if kind == INCR:
        return log.join(slice_.select(*shape.key).distinct(), list(shape.key), "left_semi")
    if kind == SECT:
        return log.join(sections(slice_, shape), shape.chunk, "left_semi")
    return log


def compare(source: DataFrame, target: DataFrame, kind: str, shape: Shape) -> DataFrame:
    """New versions with the flags ``inserted``, ``updated`` and ``deleted``.

    ``source`` has one row per key, ``target`` holds open versions. An incremental
    transfer keeps keys that the slice lacks; the others close them.
    """
    s, t = source.alias("s"), target.select(*shape.key, "is_active", *shape.rest).alias("t")
    joined = s.join(t, [F.col(f"s.{k}") == F.col(f"t.{k}") for k in shape.key], "left" if kind == INCR else "full")
    active = F.coalesce(F.col("s.is_active"), F.lit(False))
    was = F.coalesce(F.col("t.is_active"), F.lit(False))
    changed = joined.filter((active != was) | (active & any_of([differs(F.col(f"s.{c}"), F.col(f"t.{c}")) for c in shape.rest])))

    def flag(condition: Column, name: str) -> Column:
        return condition.cast("int").alias(name)

    return changed.select(
        *[F.coalesce(F.col(f"s.{k}"), F.col(f"t.{k}")).alias(k) for k in shape.key],
        active.alias("is_active"),
        # A tombstone keeps the last values.
        *[F.when(active, F.col(f"s.{c}")).otherwise(F.col(f"t.{c}")).alias(c) for c in shape.rest],
        flag(active & ~was, "inserted"),
        flag(active & was, "updated"),
        flag(~active & was, "deleted"),
    )


def merge(slice_: DataFrame, log: DataFrame, kind: str, shape: Shape) -> DataFrame:
    """Compare the slice with the open versions of the part of the log that it can touch."""
    return compare(one_per_key(slice_, shape), open_versions(narrowed(log, slice_, kind, shape), shape), kind, shape)


def bulk(slice_: DataFrame, shape: Shape) -> DataFrame:
    """Active rows as they are: a first load, a portion of a mart, or its full resend."""
    one, none = F.lit(1), F.lit(0)
    return slice_.filter("is_active").select(*shape.landed, one.alias("inserted"), none.alias("updated"), none.alias("deleted"))


def statistics(result: DataFrame) -> DataFrame:
    """Counts of inserted, updated and deleted keys; zeros for an empty result."""
    return result.agg(*_statistics())


def _statistics() -> list[Column]:
    return [F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(f"{c}_row_cnt") for c in ("inserted", "updated", "deleted")]


def nothing(slice_: DataFrame, shape: Shape) -> DataFrame:
    return bulk(slice_.limit(0), shape)


def plan_transfer(dataset_type: str, kind: str, target_is_empty: bool) -> str:
    """Which of ``skip``, ``bulk`` and ``merge`` a transfer takes."""
    if kind == SKIP:
        return "skip"
    if dataset_type == "mart" or target_is_empty:
        return "bulk"
    return "merge"


def survey(slice_: DataFrame, shape: Shape) -> dict[str, int]:
    """One pass over what landed: rows, rows with a null key, active rows without some value."""
    lacking = F.col("is_active") & any_null(list(shape.rest)) if shape.rest else F.lit(False)
    seen = slice_.agg(
        F.count("*").alias("rows"),
        F.count(F.when(any_null(list(shape.key)), 1)).alias("null_keys"),
        F.count(F.when(lacking, 1)).alias("lacking"),
    )
    return seen.first().asDict()


def validate(slice_: DataFrame, seen: dict[str, int], shape: Shape, unique: bool) -> None:
    """Judge what ``survey`` saw.

    ``unique`` is for transfers that don't compare: there a repeated key is an error,
    while a merge takes one row per key and checks the versions that it makes.
    """
    if seen["null_keys"]:
        raise StrataError(f"{seen['null_keys']} rows have a null in the primary key", sqlstate=NOT_NULL_VIOLATION)
    if not unique:
        return
    check_values(seen["lacking"])
    if n := duplicate_key_count(slice_, shape).first()["duplicates"]:
        raise StrataError(f"{n} active rows repeat a primary key", sqlstate=UNIQUE_VIOLATION)


def check_values(lacking: int) -> None:
    """Active rows must have all values; tombstones keep what there was."""
    if lacking:
        raise StrataError(f"{lacking} active rows lack a value outside the key", sqlstate=NOT_NULL_VIOLATION)


def outcome(versions: DataFrame, shape: Shape) -> tuple[dict[str, int], int]:
    """Statistics of written versions, and how many lack a value, in one pass."""
    lacking = F.col("is_active") & any_null(list(shape.rest)) if shape.rest else F.lit(False)
    got = versions.agg(*_statistics(), F.count(F.when(lacking, 1)).alias("lacking")).first().asDict()
    return got, got.pop("lacking")


def transfer(dataset_type: str, kind: str, slice_: DataFrame, log: DataFrame, target_is_empty: bool, shape: Shape) -> DataFrame:
    """The new versions of a build, with their flags."""
    way = plan_transfer(dataset_type, kind, target_is_empty)
    if way == "skip":
        return nothing(slice_, shape)
    if way == "bulk":
        return bulk(slice_, shape)
    if kind not in (INIT, INCR, SECT):
        raise StrataError(f"transfer type {kind!r} is no store's", sqlstate=INTERNAL_ERROR)
    return merge(slice_, log, kind, shape)


def as_versions(result: DataFrame, build_id: int, shape: Shape) -> DataFrame:
    """The rows to append to the log."""
    return result.select(*shape.key, F.lit(build_id).cast("long").alias("build_id"), "is_active", *shape.rest)


def with_next(log: DataFrame, shape: Shape) -> DataFrame:
    """The log with ``next_build_id`` of the same key, null for the newest."""
    own = Window.partitionBy(*shape.key).orderBy("build_id")
    return log.withColumn("next_build_id", F.lead("build_id").over(own))
