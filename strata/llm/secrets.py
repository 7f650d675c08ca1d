"""Secret scans: known shapes and a randomness test battery, in DataFrame functions only.

Three known kinds (``assign``, ``access``, ``hex``) are found by pattern. The kind
``random`` comes from a test battery over long tokens:

* the encoding is inferred from the characters (hexadecimal, base 32 and 36 of either
  case, base 62, 64, URL-safe 64, and these mixed; in one case also with marks between
  groups, which are left out of the tests). A token of one case needs a digit and a
  letter: words, numbers and paths of such letters alone are not judged;
* three tests ask whether the token could be uniform over that alphabet: chi-squared of
  its character counts, the number of runs above and below the middle, and the serial
  correlation of neighbours; Fisher's method combines their p-values. Random tokens have
  evenly spread p-values, others have mostly small ones;
* a token is reported if its p-value exceeds the threshold of its class of lengths. It is
  the least one at which no more than ``rate`` of the reported tokens are estimated to be
  false: of the tokens above a threshold, those are true that an even spread of p-values
  accounts for, and how high this spread lies follows from the upper half of p-values.
  Where many words look nearly random, as short ones do, the threshold rises; it is never
  below ``LEAST_P``, nor where the Benjamini-Hochberg rule at ``rate`` calls a token not
  random. Short tokens thus don't share a threshold with long ones.

The rule needs counts of p-values only: a histogram of bounded size, never a sort.

Positions are code points, ends exclusive. They are sums of the lengths of gaps and
matches; sums run in blocks, so texts with very many matches stay near linear. Cutting a
text at its spans scans it once per span.

Defined results. Null or empty text: no spans. Spans of several kinds may overlap. Every
row is judged for itself, repeated rows too; each counts in the statistics. An empty
table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import named, stash

#: The known shapes. ``hex`` and ``access`` hold their least lengths, which
#: leaves out nothing but failing matches; ``assign`` can't, as a failing match hides text.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
TOKEN = r"[A-Za-z0-9+/_-]{20,}"
ASSIGNED_LEAST = 6

KINDS = ("assign", "access", "hex", "random")

_DIGITS, _UPPER, _LOWER = "0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Encodings in the order in which they are tried: the pattern of the whole token, what it
#: has to contain, its alphabet, and the marks that only separate groups.
ENCODINGS = (
    (r"^[0-9a-f]+$", (r"[0-9]", r"[a-f]"), _DIGITS + "abcdef", ""),
    (r"^[0-9A-F]+$", (r"[0-9]", r"[A-F]"), _DIGITS + "ABCDEF", ""),
    (r"^[A-Z2-7]+$", (r"[2-7]", r"[A-Z]"), _UPPER + "234567", ""),
    (r"^[a-z2-7]+$", (r"[2-7]", r"[a-z]"), _LOWER + "234567", ""),
    (r"^[A-Z0-9]+$", (r"[0-9]", r"[A-Z]"), _DIGITS + _UPPER, ""),
    (r"^[a-z0-9]+$", (r"[0-9]", r"[a-z]"), _DIGITS + _LOWER, ""),
    (r"^[0-9a-f-]+$", (r"[0-9]", r"[a-f]"), _DIGITS + "abcdef", "-"),
    (r"^[0-9A-F-]+$", (r"[0-9]", r"[A-F]"), _DIGITS + "ABCDEF", "-"),
    (r"^[A-Z0-9+/_-]+$", (r"[0-9]", r"[A-Z]"), _DIGITS + _UPPER, "+/_-"),
    (r"^[a-z0-9+/_-]+$", (r"[0-9]", r"[a-z]"), _DIGITS + _LOWER, "+/_-"),
    (r"^[A-Za-z0-9]+$", (r"[A-Z]", r"[a-z]"), _DIGITS + _UPPER + _LOWER, ""),
    (r"^[A-Za-z0-9+/]+$", (r"[A-Z]", r"[a-z]"), _UPPER + _LOWER + _DIGITS + "+/", ""),
    (r"^[A-Za-z0-9_-]+$", (r"[A-Z]", r"[a-z]"), _UPPER + _LOWER + _DIGITS + "-_", ""),
    (r"^[A-Za-z0-9+/_-]+$", (r"[A-Z]", r"[a-z]"), _UPPER + _LOWER + _DIGITS + "+/-_", ""),
)
#: Length classes: their least lengths. Rate of false ones among the reported tokens.
CLASSES = (20, 24, 32, 48, 64, 128)
RATE = 0.05
#: Steps of the histogram of p-values from 0 to 1; the least p-value of a reported token.
STEPS, LEAST_P = 1000, 0.001

#: Coefficients of the rational fit of erfc (relative error below 1.2e-7).
ERFC = (-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277)

BLOCK = 256


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once."""
    return F.transform(F.array(value), body)[0]


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0).cast("long"), lambda s, x: s + x)


def _running(values: Column, fold: Callable[[Column], Column], both: Callable[[Column, Column], Column]) -> Column:
    """Inclusive prefix folds of an array of longs, in blocks."""

    def with_bases(bases: Column) -> Column:
        def at(i: Column) -> Column:
            own = fold(F.slice(values, (F.floor(i / BLOCK) * BLOCK + 1).cast("int"), i % BLOCK + 1))
            return both(bases[F.floor(i / BLOCK).cast("int")], own)

        return F.transform(values, lambda _, i: at(i))

    blocks = F.sequence(F.lit(0), F.floor((F.size(values) - 1) / BLOCK).cast("int"))
    folds = F.transform(blocks, lambda b: fold(F.slice(values, b * BLOCK + 1, F.lit(BLOCK))))
    bases = let(folds, lambda s: F.transform(blocks, lambda b: fold(F.slice(s, F.lit(1), b))))
    return F.when(F.size(values) > 0, let(bases, with_bases)).otherwise(F.array().cast("array<bigint>"))


def running_sums(values: Column) -> Column:
    return _running(values, _sum, lambda a, b: a + b)


def running_maxima(values: Column) -> Column:
    """Of numbers from 0 on."""
    return _running(values, lambda x: F.coalesce(F.array_max(x), F.lit(0).cast("long")), F.greatest)


def _found(text: Column, pattern: str, kind: str) -> Column:
    """All matches of ``pattern``: kind, start, stop and the matched string."""

    def placed(gaps: Column, hits: Column) -> Column:
        widths = F.zip_with(F.slice(gaps, F.lit(1), F.size(hits)), hits, lambda g, h: (F.length(g) + F.length(h)).cast("long"))
        return let(
            widths,
            lambda w: let(
                running_sums(w),
                lambda stops: F.zip_with(
                    stops,
                    hits,
                    lambda stop, h: F.struct(F.lit(kind).alias("kind"), (stop - F.length(h)).alias("start"), stop.alias("stop"), h.alias("hit")),
                ),
            ),
        )

    none = F.array().cast("array<struct<kind:string,start:bigint,stop:bigint,hit:string>>")
    some = let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda hits: let(F.split(text, pattern, -1), lambda gaps: placed(gaps, hits)))
    return F.when(text.rlike(pattern), some).otherwise(none)


def _tail(z: Column) -> Column:
    """Two-sided normal p-value of ``z``."""

    def fit(x: Column) -> Column:
        def poly(t: Column) -> Column:
            total = F.lit(ERFC[-1])
            for c in ERFC[-2::-1]:
                total = total * t + F.lit(c)
            return t * F.exp(total - x * x)

        return let(F.lit(1.0) / (F.lit(1.0) + x * 0.5), poly)

    return let(F.abs(z) / math.sqrt(2.0), fit)


def p_value(token: Column, alphabet: Column) -> Column:
    """Fisher's combination of the three tests for uniformity over the characters of ``alphabet``."""
    k, n = F.length(alphabet).cast("double"), F.length(token).cast("double")
    half = F.floor(k / 2).cast("int")

    def count(of: Column, text: Column) -> Column:
        return (F.length(text) - F.length(F.replace(text, of, F.lit("")))) / F.length(of)

    letters = F.filter(F.split(alphabet, ""), lambda c: c != "")
    squares = F.aggregate(letters, F.lit(0.0), lambda s, c: s + F.pow(count(c, token), F.lit(2.0)))
    spread = 2.0 / (9.0 * (k - 1))
    chi_z = (F.cbrt((squares * k / n - n) / (k - 1.0)) - (1.0 - spread)) / F.sqrt(spread)
    chi = let(chi_z, lambda z: F.when(z > 0, _tail(z) / 2).otherwise(1.0 - _tail(z) / 2))

    def runs_of(b: Column) -> Column:
        ones = count(F.lit("1"), b)

        def judged(x: Column) -> Column:  # x: expected runs less one
            seen = 1.0 + count(F.lit("01"), b) + count(F.lit("10"), b)
            return F.when(x < 1.5, F.pow(F.lit(2.0), 1.0 - n)).otherwise(_tail((seen - 1.0 - x) / F.sqrt(x * (x - 1.0) / (n - 1.0))))

        return let(2.0 * ones * (n - ones) / n, judged)

    halves = F.concat(F.repeat(F.lit("0"), half), F.repeat(F.lit("1"), k.cast("int") - half))
    runs = let(F.call_function("translate", token, alphabet, halves), runs_of)
    places = F.transform(F.filter(F.split(token, ""), lambda c: c != ""), lambda c: F.call_function("instr", alphabet, c) - (k + 1) / 2.0)
    products = let(places, lambda x: F.aggregate(F.zip_with(F.slice(x, F.lit(1), F.size(x) - 1), F.slice(x, F.lit(2), F.size(x) - 1), lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v))
    serial = _tail(products / ((k * k - 1) / 12.0) / F.sqrt(n - 1.0))
    half_sum = -(F.ln(F.greatest(chi, F.lit(1e-200))) + F.ln(F.greatest(runs, F.lit(1e-200))) + F.ln(F.greatest(serial, F.lit(1e-200))))
    return let(half_sum, lambda x: F.exp(-x) * (1.0 + x + x * x / 2.0))


def _judged(token: Column) -> Column:
    """p-value under the first encoding that the token may have; null if none."""
    found = None
    for whole, needed, alphabet, marks in ENCODINGS:
        fits = token.rlike(whole)
        for part in needed:
            fits = fits & token.rlike(part)
        own = F.struct(F.lit(alphabet).alias("alphabet"), F.lit(marks).alias("marks"))
        found = F.when(fits, own) if found is None else found.when(fits, own)
    return let(found, lambda e: F.when(e.isNotNull(), let(F.call_function("translate", token, e["marks"], F.lit("")), lambda t: p_value(t, e["alphabet"]))))


def _class(length: Column) -> Column:
    out = F.lit(0)
    for k, least in enumerate(CLASSES):
        out = F.when(length >= least, F.lit(k)).otherwise(out)
    return out


def raw_spans(text: Column) -> Column:
    """Candidate spans: kind, start, stop; for ``random`` also length class and histogram step."""
    shape = "array<struct<kind:string,start:bigint,stop:bigint,class:int,step:int>>"

    def plain(found: Column) -> Column:
        return F.transform(found, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["stop"].alias("stop"), F.lit(0).alias("class"), F.lit(0).alias("step")))

    # Each assignment's value is read from the match itself: it ends where the match ends.
    assign = plain(F.filter(_found(text, ASSIGN, "assign"), lambda s: F.length(F.regexp_extract(s["hit"], ASSIGN, 2)) >= ASSIGNED_LEAST))
    scored = F.transform(
        _found(text, TOKEN, "random"),
        lambda s: let(
            _judged(s["hit"]),
            lambda p: F.struct(
                s["kind"].alias("kind"),
                s["start"].alias("start"),
                s["stop"].alias("stop"),
                _class(s["stop"] - s["start"]).alias("class"),
                F.least(F.floor(p * STEPS).cast("int"), F.lit(STEPS - 1)).alias("step"),
            ),
        ),
    )
    return F.concat(
        assign.cast(shape),
        plain(_found(text, ACCESS, "access")).cast(shape),
        plain(_found(text, HEX, "hex")).cast(shape),
        F.filter(scored, lambda s: s["step"].isNotNull()).cast(shape),
    )


def find_secrets(docs: DataFrame, text_col: str = "text", out: str = "secrets", keep: list[str] | None = None, rate: float = RATE) -> DataFrame:
    """The columns ``keep`` (default: all) and ``out``: an array of (kind, start, stop).

    Spans are sorted by start, then kind as in ``KINDS``, then stop. A column already
    named ``out`` is replaced. The candidates rest in a written table between the pass
    that counts p-values and the pass that decides.
    """
    kept = [named(c) for c in (docs.columns if keep is None else keep) if c.lower() != out.lower()]
    raw = stash(docs.select(*kept, raw_spans(F.coalesce(named(text_col), F.lit(""))).alias(out)), "secrets")
    limits = _limits(raw.select(F.explode(out).alias("s")).filter("s.kind = 'random'").select("s.class", "s.step"), rate)
    order = F.array(*[F.lit(k) for k in KINDS])
    least = F.array(*[F.lit(limits.get(k, STEPS)) for k in range(len(CLASSES))])
    held = F.filter(out, lambda s: (s["kind"] != "random") | (s["step"] >= least[s["class"]]))
    ranked = F.array_sort(F.transform(held, lambda s: F.struct(s["start"].alias("start"), F.array_position(order, s["kind"]).cast("int").alias("rank"), s["stop"].alias("stop"))))
    spans = F.transform(ranked, lambda s: F.struct(F.element_at(order, s["rank"]).alias("kind"), s["start"].alias("start"), s["stop"].alias("stop")))
    return raw.select(*kept, spans.alias(out))


def _limits(steps: DataFrame, rate: float) -> dict[int, int]:
    """Per length class, the least histogram step of reported tokens.

    At most ``len(CLASSES) * STEPS`` counts come to the driver.
    """
    counts: dict[int, list[int]] = {}
    for r in steps.groupBy("class", "step").agg(F.count("*").alias("n")).collect():
        counts.setdefault(r["class"], [0] * STEPS)[r["step"]] = r["n"]
    return {k: least_step(own, rate) for k, own in counts.items()}


def least_step(counts: list[int], rate: float) -> int:
    """The least step from which on at most ``rate`` of the tokens are estimated to be false.

    Per step, an even spread of random tokens is estimated from each part of the upper
    half, and the lowest estimate counts. It is never that of no token at all: few tokens,
    which tell nothing about the spread, are reported.
    """
    above = [0] * (len(counts) + 1)
    for step in range(len(counts) - 1, -1, -1):
        above[step] = above[step + 1] + counts[step]
    half = len(counts) // 2
    per_step = min(max(above[s], 1) / (len(counts) - s) for s in range(half, len(counts) * 9 // 10 + 1))
    # Tokens that Benjamini and Hochberg's rule calls not random are out in any case.
    rejected = [s for s in range(half) if (s + 1) / len(counts) * above[0] <= rate * (above[0] - above[s + 1])]
    for step in range(max(math.ceil(LEAST_P * len(counts)), *(s + 1 for s in rejected[-1:]), 0), half):
        if above[step] * (1 - rate) <= per_step * (len(counts) - step):
            return step
    return half


def redact(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """``text`` with each maximal run of overlapping spans replaced by ``mark``.

    ``spans`` must be sorted by start, as ``find_secrets`` returns them.
    """

    def cut(reach: Column) -> Column:
        """``reach``: 0, then the highest stop of the spans so far."""
        opening = F.filter(F.sequence(F.lit(0), F.size(spans) - 1), lambda i: (i == 0) | (spans[i]["start"] >= reach[i]))
        between = F.transform(opening, lambda i: F.substr(text, (reach[i] + 1).cast("int"), (spans[i]["start"] - reach[i]).cast("int")))
        rest = F.substr(text, (F.element_at(reach, -1) + 1).cast("int"))
        return F.array_join(F.concat(between, F.array(rest)), mark)

    stops = F.transform(spans, lambda s: s["stop"])
    return F.when(F.size(spans) == 0, text).otherwise(let(F.concat(F.array(F.lit(0).cast("long")), running_maxima(stops)), cut))
