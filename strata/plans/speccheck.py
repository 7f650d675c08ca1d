"""What a build spec has to satisfy: tables of demands, and one pass that lists all findings.

Every demand that a spec breaks makes a finding with its place. The one that stands first
in the text is raised; the others are named in its hint, so a user can mend all at once.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

from ..errors import DUPLICATE_OBJECT, INVALID_PARAMETER_VALUE, StrataError
from ..sources.connectors import WAREHOUSE
from . import commands as C

#: Fixed value: the longest name of a table.
MAX_TABLE_NAME = 63
#: Per kind of dataset, the transfers of its modes; named modes have fewer.
TRANSFERS = {"store": ("init", "incr", "sect"), "mart": ("appd", "init", "skip")}
NAMED_MODES = {
    "store": {"initial": ("init",), "increment": ("incr", "sect"), "skip": ()},
    "mart": {"initial": ("init",), "increment": ("appd",), "skip": ("skip",)},
}
#: Per kind, modes of which a spec has one at least, and why.
NEEDED_MODES = {
    "store": (("initial", "increment"), "no flow could run it otherwise"),
    "mart": (("skip",), "nothing could drop what has gathered otherwise"),
}


@dataclass(frozen=True)
class Option:
    """An option's kind of value, the text of its demand, and what turns its text into the value."""

    kind: str
    demand: str
    read: Callable[[str], object]
    fits: Callable[[object], bool] = lambda value: True
    default: object = None
    needed: str | None = None


OPTIONS = {
    "parallel": Option("number", "a whole number of 1 at least", int, lambda n: n >= 1, default=1),
    "chunk_attr": Option("word", "the name of an attribute, without quotes", str, needed="an attribute of the primary key"),
}


@dataclass(frozen=True, order=True)
class Finding:
    pos: int
    message: str
    sqlstate: str = INVALID_PARAMETER_VALUE


def repeated(names: Iterable[C.Ref], what: str) -> Iterator[Finding]:
    """A finding for each name that stood there before."""
    seen: Counter[str] = Counter()
    for n in names:
        seen[n.text] += 1
        if seen[n.text] > 1:
            yield Finding(n.pos, f"{what} {n.text!r} is listed twice", DUPLICATE_OBJECT)


def forbidden(names: Iterable[C.Ref], text: str, why: str) -> Iterator[Finding]:
    return (Finding(n.pos, why) for n in names if n.text == text)


def _options(c: C.CreateBuildSpec) -> Iterator[Finding]:
    yield from (Finding(f.pos, f.message) for f in repeated((o.name for o in c.options), "option"))
    for o in c.options:
        known = OPTIONS.get(o.name.text)
        if known is None:
            yield Finding(o.name.pos, f"unknown option {o.name.text!r}; there are {', '.join(OPTIONS)}")
        elif o.value.kind != known.kind or not known.fits(known.read(o.value.text)):
            yield Finding(o.value.pos, f"{o.name.text} is {known.demand}")
    given = {o.name.text for o in c.options}
    for name, known in OPTIONS.items():
        if known.needed and name not in given:
            yield Finding(c.spec.pos, f"the option {name} is missing: {known.needed}")


def _head(c: C.CreateBuildSpec) -> Iterator[Finding]:
    if c.spec.num < 1:
        yield Finding(c.spec.pos, "the number of a spec is 1 at least")
    landing = f"{c.spec.dataset.partition('.')[2]}_{c.spec.num}_$"
    if len(landing) > MAX_TABLE_NAME:
        yield Finding(c.spec.pos, f"the name of the landing table {landing} is longer than {MAX_TABLE_NAME} characters")
    yield from repeated((m.code for m in c.modes), "mode")
    yield from repeated(c.using, "connection")
    yield from repeated(c.sources, "source")
    yield from forbidden(c.using, WAREHOUSE, "warehouse is never declared: each spec has it")
    yield from forbidden(c.sources, c.spec.dataset, "a spec does not read its own dataset")
    if not c.body.text or c.body.text.isspace():
        yield Finding(c.body.pos, "the body is empty")


def _modes(c: C.CreateBuildSpec, kind: str) -> Iterator[Finding]:
    for m in c.modes:
        allowed = NAMED_MODES[kind].get(m.code.text, TRANSFERS[kind])
        if m.transfer not in allowed:
            may = f"its type is {' or '.join(allowed)}" if allowed else f"a {kind} has none of that name"
            yield Finding(m.code.pos, f"mode {m.code.text!r} of a {kind} can't have the transfer type {m.transfer!r}: {may}")
    needed, why = NEEDED_MODES[kind]
    if not any(m.code.text in needed for m in c.modes):
        yield Finding(c.spec.pos, f"a {kind}'s spec needs the mode {' or '.join(needed)}: {why}")


def _raise_first(findings: Iterable[Finding]) -> None:
    first, *others = sorted(findings, key=lambda f: f.pos) or [None]
    if first is not None:
        more = "; ".join(f.message for f in others)
        raise StrataError(first.message, pos=first.pos, sqlstate=first.sqlstate, hint=f"also: {more}" if more else None)


def check_text(c: C.CreateBuildSpec) -> dict[str, object]:
    """What a spec's text alone must satisfy; returns the values of its options."""
    _raise_first([*_head(c), *_options(c)])
    return {n: o.default for n, o in OPTIONS.items()} | {o.name.text: OPTIONS[o.name.text].read(o.value.text) for o in c.options}


def check_modes(c: C.CreateBuildSpec, kind: str) -> None:
    """What its modes must satisfy, given the kind of its dataset."""
    _raise_first(_modes(c, kind))
