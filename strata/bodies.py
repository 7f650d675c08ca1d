"""Bodies: Python text of a spec that builds DataFrames on the driver.

A body sees connection factories, parameters and ``print``, nothing else of the platform.
What it prints goes to the journal. It can be stopped: its Spark jobs are cancelled and
an exception is raised in its thread.
"""

from __future__ import annotations

import ctypes
import textwrap
import threading
import traceback
from collections.abc import Callable

from .errors import EXTERNAL_ERROR, StrataError

NAME = "<body>"


class Stopped(BaseException):
    """Raised in the thread of a body that is stopped."""


def compiled(body: str, pos: int | None = None):
    """The body as code; a syntax error is an error of the command, at its place."""
    plain = textwrap.dedent(body)
    try:
        return compile(plain, NAME, "exec")
    except SyntaxError as e:
        at = None
        if pos is not None and e.lineno:
            lines = body.splitlines(keepends=True)
            indent = len(lines[e.lineno - 1]) - len(plain.splitlines(keepends=True)[e.lineno - 1]) if e.lineno <= len(lines) else 0
            at = pos + sum(map(len, lines[: e.lineno - 1])) + indent + max((e.offset or 1) - 1, 0)
        raise StrataError(f"the body is no Python: {e.msg} (line {e.lineno})", pos=at) from None


def run(body: str, names: dict[str, object], say: Callable[[str], None], pos: int | None = None) -> None:
    """Execute a body; every printed line goes to ``say``."""

    def printed(*values: object, sep: str = " ", end: str = "\n", file=None, flush: bool = False) -> None:
        for line in (sep.join(map(str, values)) + end).rstrip("\n").split("\n"):
            say(line)

    code = compiled(body, pos)
    try:
        exec(code, {"__name__": "__main__", "print": printed, **names})  # noqa: S102
    except StrataError:
        raise
    except Exception as e:
        own = [f for f in traceback.extract_tb(e.__traceback__) if f.filename == NAME]
        where = f" (line {own[-1].lineno} of the body)" if own else ""
        text = str(e).strip().splitlines()
        raise StrataError(f"{type(e).__name__}: {text[0][:500] if text else ''}{where}", sqlstate=EXTERNAL_ERROR) from e


def interrupt(thread: threading.Thread) -> None:
    """Raise ``Stopped`` in a thread at its next step in Python."""
    if thread.ident is not None and thread.is_alive():
        ctypes.pythonapi.PyThreadState_SetAsyncExc(ctypes.c_ulong(thread.ident), ctypes.py_object(Stopped))
