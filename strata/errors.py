"""One error type for the whole platform: a message, its SQLSTATE, a place in the text, a hint."""

from __future__ import annotations

from dataclasses import dataclass, field

#: The SQLSTATE codes that callers may rely on.
SYNTAX_ERROR = "42601"
DUPLICATE_SCHEMA = "42P06"
DUPLICATE_OBJECT = "42710"
UNDEFINED_OBJECT = "42704"
INVALID_SCHEMA_NAME = "3F000"
INVALID_PARAMETER_VALUE = "22023"
NOT_IN_PREREQUISITE_STATE = "55000"
DEPENDENT_OBJECTS = "2BP01"
FEATURE_NOT_SUPPORTED = "0A000"
CONNECTION_FAILURE = "08001"
EXTERNAL_ERROR = "38000"
QUERY_CANCELED = "57014"
NOT_NULL_VIOLATION = "23502"
UNIQUE_VIOLATION = "23505"
INTERNAL_ERROR = "XX000"


@dataclass(eq=False)
class StrataError(Exception):
    """``pos`` counts characters from 0 in the text of the whole request."""

    message: str
    sqlstate: str = field(default=SYNTAX_ERROR, kw_only=True)
    pos: int | None = field(default=None, kw_only=True)
    hint: str | None = field(default=None, kw_only=True)

    def __str__(self) -> str:
        return self.message


def line_and_column(text: str, pos: int) -> tuple[int, int]:
    """Line and column, from 1, of a position in ``text``."""
    before = text[:pos]
    return before.count("\n") + 1, pos - (before.rfind("\n") + 1) + 1


def describe(error: StrataError, text: str) -> str:
    """The error as a client shows it, with its place in ``text``."""
    out = f"[{error.sqlstate}] {error.message}"
    if error.pos is not None:
        line, column = line_and_column(text, error.pos)
        out += f" (line {line}, column {column})"
    return out + (f"\nHINT: {error.hint}" if error.hint else "")
