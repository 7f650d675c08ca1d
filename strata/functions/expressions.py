"""Expressions of the data plane: null-safe difference, chunk numbers, any-null."""

from __future__ import annotations

from functools import reduce
from operator import and_, or_

from pyspark.sql import Column
from pyspark.sql import functions as F


def differs(a: Column, b: Column) -> Column:
    """IS DISTINCT FROM."""
    return ~a.eqNullSafe(b)


def any_of(conditions: list[Column]) -> Column:
    return reduce(or_, conditions, F.lit(False))


def all_of(conditions: list[Column]) -> Column:
    return reduce(and_, conditions, F.lit(True))


def any_null(columns: list[str]) -> Column:
    return any_of([F.col(c).isNull() for c in columns])


def chunk_number(attr: Column, chunks: int) -> Column:
    """1..chunks by the hash of one key attribute; equal values share a number."""
    return F.lit(1) if chunks <= 1 else (F.pmod(F.xxhash64(attr.cast("string")), F.lit(chunks)) + 1).cast("int")
