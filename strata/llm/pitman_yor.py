"""Pitman-Yor restaurants in numpy: how many tables the customers of a dish take.

Given all other counts, the number t of tables at which the c customers of a dish sit in
a restaurant has the weight

    S(c, t) * prod over i from 1 to t - 1 of (strength + discount * (others + i)) * (a + i) / (b + i)

where S are generalized Stirling numbers of the discount, ``others`` are the restaurant's
tables of other dishes, and (a + i) / (b + i) is the probability of the dish in the
parent restaurant once i customers more from here sit there.

Up to ``EXACT`` customers t is drawn from these weights. Beyond that customers are seated
in order, in jumps from one new table to the next, along several paths; one of them is
chosen by the ratio of its weight to the probability with which it was drawn. Both ways
draw from the same distribution, which the tests hold against each other.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

EXACT, PATHS = 256, 24
#: Entries that are weighed at once; customers up to which weights are products, not sums of logarithms.
AT_ONCE, PRODUCTS = 1 << 14, 16


@lru_cache(maxsize=8)
def log_stirling(discount: float, most: int) -> np.ndarray:
    """ln of the generalized Stirling numbers S(c, t): ways to seat c customers at t tables."""
    out = np.full((most + 1, most + 1), -np.inf)
    out[0, 0] = 0.0
    for c in range(most):
        stay = out[c] + np.log(np.maximum(c - discount * np.arange(most + 1), 1e-300))
        out[c + 1] = np.logaddexp(stay, np.concatenate([[-np.inf], out[c, :-1]]))
        out[c + 1, c + 2 :] = -np.inf
    return out


def log_gamma(x: np.ndarray) -> np.ndarray:
    """ln of the gamma function for x > 0: Stirling's series from x + 8 on."""
    z = x + 8
    series = (z - 0.5) * np.log(z) - z + 0.9189385332046727 + 1 / (12 * z) - 1 / (360 * z**3) + 1 / (1260 * z**5)
    for k in range(0, 8, 4):
        series = series - np.log((x + k) * (x + k + 1) * (x + k + 2) * (x + k + 3))
    return series


def seat(c: np.ndarray, others: np.ndarray, a: np.ndarray, b: np.ndarray, discount: float, strength: float, rng: np.random.Generator, exact: int = EXACT) -> np.ndarray:
    """Tables of each entry's ``c`` customers, drawn anew."""
    c = c.astype(np.int64)
    t = np.minimum(c, 1)
    few = np.flatnonzero((c > 1) & (c <= exact))
    few = few[np.argsort(c[few].astype(np.uint16) if exact < 1 << 16 else c[few], kind="stable")]
    for own in np.split(few, np.flatnonzero(np.diff(c[few])) + 1):
        if not len(own):
            continue
        n = int(c[own[0]])
        ways, weigh = log_stirling(discount, max(exact, 2))[n, 1 : n + 1], _by_products if n <= PRODUCTS else _by_logarithms
        for at in range(0, len(own), AT_ONCE):
            part = own[at : at + AT_ONCE]
            up_to = weigh(ways, others[part], a[part], b[part], discount, strength)
            t[part] = 1 + (up_to[:-1] <= rng.random(len(part)) * up_to[-1]).sum(axis=0)
    many = np.flatnonzero(c > exact)
    for at in range(0, len(many), AT_ONCE):
        part = many[at : at + AT_ONCE]
        t[part] = _seat_in_jumps(c[part], others[part], a[part], b[part], discount, strength, rng)
    return t


def _by_products(ways: np.ndarray, others: np.ndarray, a: np.ndarray, b: np.ndarray, discount: float, strength: float) -> np.ndarray:
    """Running sums of the weights of 1, 2, ... tables: a row for each number, a column for each entry."""
    ways = np.exp(ways - ways.max())
    up_to = np.empty((len(ways), len(a)))
    up_to[0], weight, first = ways[0], np.ones(len(a)), strength + discount * others
    for i in range(1, len(ways)):
        weight *= (first + discount * i) * (a + i) / (b + i)
        np.add(up_to[i - 1], weight * ways[i], out=up_to[i])
    return up_to


def _by_logarithms(ways: np.ndarray, others: np.ndarray, a: np.ndarray, b: np.ndarray, discount: float, strength: float) -> np.ndarray:
    """As ``_by_products``, for any number of tables."""
    i = np.arange(1, len(ways))[:, None]
    weight = np.zeros((len(ways), len(a)))
    np.cumsum(np.log((strength + discount * (others + i)) * (a + i) / (b + i)), axis=0, out=weight[1:])
    weight += ways[:, None]
    return np.cumsum(np.exp(weight - weight.max(axis=0)), axis=0)


def _seat_in_jumps(c: np.ndarray, others: np.ndarray, a: np.ndarray, b: np.ndarray, discount: float, strength: float, rng: np.random.Generator) -> np.ndarray:
    """One of PATHS seatings of each entry's customers, by importance."""
    n = len(c)
    entry = np.tile(np.arange(n), PATHS)
    sat, tables, weight = np.ones(n * PATHS), np.ones(n * PATHS), np.zeros(n * PATHS)
    live = np.arange(n * PATHS)
    while len(live):
        own, s, t = entry[live], sat[live], tables[live]
        new = (strength + discount * (others[own] + t)) * (a[own] + t) / (b[own] + t)
        free, left = s - discount * t, c[own] - s
        # A table more changes the chances of all customers to come: paths are drawn with that in mind.
        slope = discount * (a[own] + t) / (b[own] + t) + (strength + discount * (others[own] + t)) * (b[own] - a[own]) / (b[own] + t) ** 2
        rate = new * np.exp((slope - discount) * np.log1p(left / (free + new)))
        # Drawn: whether the next customer joins; then m or more others join before the next
        # table with the probability (x / (x + m)) ** rate.
        joins = rng.random(len(live)) * (free + rate) < free
        x = np.maximum(free + 1 + (rate - 1) / 2, 0.05)
        with np.errstate(over="ignore"):
            more = np.minimum(np.floor(x * np.expm1(-np.log1p(-rng.random(len(live))) / rate)), left - 1)
        joined = np.where(joins, 1 + more, 0)
        last = joined >= left
        beyond = np.log(free) - rate * np.log1p(more / x)
        drawn = np.where(joins, np.where(last, beyond, beyond + np.log(-np.expm1(-rate * np.log1p(1 / (x + more))))), np.log(rate)) - np.log(free + rate)
        weight[live] += log_gamma(free + joined) - log_gamma(free) + np.where(last, 0, np.log(new)) - drawn
        sat[live] = s + joined + ~last
        tables[live] = t + ~last
        live = live[sat[live] < c[own]]
    weight = weight.reshape(PATHS, n)
    chosen = np.argmax(weight - np.log(-np.log(rng.random(weight.shape))), axis=0)
    return tables.reshape(PATHS, n)[chosen, np.arange(n)].astype(np.int64)


def discount_of(ones: float, twos: float) -> float:
    """Estimate from the numbers of types with one and two customers."""
    return float(np.clip(ones / (ones + 2 * twos), 0.05, 0.95)) if ones and twos else 0.5
