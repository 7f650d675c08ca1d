"""The declared type vocabulary and its Spark types."""

from __future__ import annotations

import re

from pyspark.sql import types as T

from ..errors import INVALID_PARAMETER_VALUE, StrataError

#: Declared names and the Spark types behind them.
SIMPLE: dict[str, T.DataType] = {
    "text": T.StringType(),
    "integer": T.IntegerType(),
    "bigint": T.LongType(),
    "boolean": T.BooleanType(),
    "date": T.DateType(),
    "timestamp": T.TimestampNTZType(),
    "timestamptz": T.TimestampType(),
}
#: ``numeric`` without a precision; Spark's decimals are bounded, so this one is lossy.
UNBOUNDED = T.DecimalType(38, 18)
MAX_PRECISION = 38


def spark_type(code: str) -> T.DataType:
    """The Spark type of a canonical type code such as ``numeric(18,2)``."""
    if code in SIMPLE:
        return SIMPLE[code]
    if code == "numeric":
        return UNBOUNDED
    if found := re.fullmatch(r"numeric\((\d+)(?:,(\d+))?\)", code):
        precision, scale = int(found[1]), int(found[2] or 0)
        if precision > MAX_PRECISION:
            raise StrataError(f"numeric holds {MAX_PRECISION} digits at most, not {precision}", sqlstate=INVALID_PARAMETER_VALUE)
        return T.DecimalType(precision, scale)
    raise StrataError(f"unknown type {code!r}")
