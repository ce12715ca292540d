"""Seatings of Pitman-Yor restaurants: how many tables each dish has, drawn by Gibbs steps.

A dish with c customers sits at t tables.  With the sizes of its tables summed out, its share of the probability of the
whole seating is ``S(c, t) * h**t * (s + d*T) * (s + d*(T+1)) * ... `` (t factors), where h is the parent's probability of
the dish, T the tables of the restaurant's other dishes, d the discount, s the strength and S the generalised
Stirling number, the number of ways to part c customers among t tables weighted by their sizes.
A Gibbs step draws t from exactly this distribution.  Dishes with over ``EXACT`` customers take ``STEPS`` Metropolis steps
towards it instead, in which S comes from its saddle point.
"""

from __future__ import annotations

from functools import lru_cache
from math import comb, gamma

import numpy as np

EXACT, STEPS, FEW = 64, 4, 8
_BINOMIAL = np.asarray([[comb(t, j) for j in range(FEW + 1)] for t in range(FEW + 1)], dtype=np.float64)
#: Dishes of a restaurant that are drawn one after another; of more, every GROUPS-th (or ``groups``-th) is drawn at once.
GROUPS = 64


@lru_cache(maxsize=4)
def log_ways(discount: float) -> np.ndarray:
    """log S(c, t) for c and t up to ``EXACT``: S(c+1, t) = S(c, t-1) + (c - d*t) * S(c, t)."""
    table = np.full((EXACT + 1, EXACT + 1), -np.inf)
    table[0, 0] = 0.0
    t = np.arange(EXACT + 1)
    for c in range(EXACT):
        with np.errstate(divide="ignore"):
            table[c + 1] = np.logaddexp(np.append(-np.inf, table[c, :-1]), table[c] + np.log(np.maximum(c - discount * t, 0)))
    return table


def log_gamma(x: np.ndarray) -> np.ndarray:
    """For positive x, by Stirling's series after a shift by 6."""
    x = np.asarray(x, dtype=np.float64)
    shift = np.log(x * (x + 1) * (x + 2) * (x + 3) * (x + 4) * (x + 5))
    y = x + 6
    return (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + (1 / 12 - (1 / 360 - 1 / (1260 * y * y)) / (y * y)) / y - shift


def _few_tables(c: np.ndarray, t: np.ndarray, discount: float) -> np.ndarray:
    """log S(c, t) - log c! for t up to ``FEW``: the binomial sum over the powers of (1-x)**d, taken relative to the first."""
    total, ratio = np.zeros(len(c)), np.ones(len(c))
    first = log_gamma(c - discount)
    for j in range(1, FEW + 1):
        a = discount * j
        ratio = np.exp(log_gamma(c - a) - first) if j > 1 else ratio
        pole = 0.0 if abs(a - round(a)) < 1e-9 else 1 / gamma(-a)
        total += (-1) ** j * np.where(j <= t, _BINOMIAL[t, j], 0) * pole * ratio
    return np.log(np.maximum(total, 1e-300)) + first - log_gamma(c + 1) - t * np.log(discount) - log_gamma(t + 1.0)


def edge_error(c: np.ndarray, discount: float) -> np.ndarray:
    """How much the saddle point is off at ``FEW`` tables."""
    edge = np.full(len(c), FEW)
    return _few_tables(c, edge, discount) - _saddle(c, edge, discount)


def log_ways_large(c: np.ndarray, t: np.ndarray, discount: float, error: np.ndarray) -> np.ndarray:
    """log S(c, t) - log c!: exact up to ``FEW`` tables, else from the saddle point, whose error falls as 1 / t from there."""
    out, few = _saddle(c, t, discount) + error * FEW / t * (t < c), np.flatnonzero(t <= FEW)
    if len(few):
        out[few] = _few_tables(c[few], t[few], discount)
    return out


@lru_cache(maxsize=4)
def _saddle_points(discount: float) -> tuple[np.ndarray, np.ndarray]:
    """log(c / t) and v, where x = 1 - exp(-v) is the saddle point, in rising order."""
    v = np.geomspace(1e-9, 60 / (1 - discount), 30_000)
    return np.log(-np.expm1(-v) * discount) + v * (1 - discount) - np.log(-np.expm1(-discount * v)), v


def _saddle(c: np.ndarray, t: np.ndarray, discount: float) -> np.ndarray:
    """log S(c, t) - log c!, from the saddle point of its generating function ((1 - (1-x)**d) / d)**t / t!."""
    c, t = c.astype(np.float64), t.astype(np.float64)
    v = np.interp(np.log(c / t), *_saddle_points(discount))
    slope = 1 / np.expm1(v) + 1 - discount - discount / np.expm1(discount * v)
    spread = np.maximum(c * slope * np.expm1(v), 1e-9)
    smooth = t * np.log(-np.expm1(-discount * v) / discount) - c * np.log(-np.expm1(-v)) - 0.5 * np.log(2 * np.pi * spread)
    return np.where(t >= c, 0.0, smooth) - log_gamma(t + 1)


def _draw_small(c: np.ndarray, log_h: np.ndarray, others: np.ndarray, discount: float, strength: float, rng: np.random.Generator) -> np.ndarray:
    ends = np.cumsum(c)
    starts = ends - c
    row = np.repeat(np.arange(len(c)), c)
    k = np.arange(ends[-1]) - starts[row]
    run = np.cumsum(np.log(strength + discount * (others[row] + k)) + log_h[row])
    weight = run - np.append(0.0, run)[starts][row] + log_ways(discount)[c[row], k + 1]
    chance = np.exp(weight - np.maximum.reduceat(weight, starts)[row])
    upto = np.cumsum(chance)
    before = np.append(0.0, upto)[starts]
    goal = before + rng.random(len(c)) * (upto[ends - 1] - before)
    return np.minimum(1 + np.add.reduceat((upto < goal[row]).astype(np.int64), starts), c)


def _draw_large(c: np.ndarray, t: np.ndarray, log_h: np.ndarray, others: np.ndarray, discount: float, strength: float, rng: np.random.Generator) -> np.ndarray:
    error = edge_error(c, discount)

    def weight(t: np.ndarray) -> np.ndarray:
        return log_gamma(strength / discount + others + t) + t * (np.log(discount) + log_h) + log_ways_large(c, t, discount, error)

    step, now = np.maximum(1.0, c ** (discount / 2)), weight(t)
    for _ in range(STEPS):
        new = t + np.rint(rng.normal(size=len(c)) * step).astype(np.int64)
        inside = (new >= 1) & (new <= c)
        then = weight(np.where(inside, new, t))
        taken = inside & (np.log(rng.random(len(c))) < then - now)
        t, now = np.where(taken, new, t), np.where(taken, then, now)
    return t


def sweep(customers: np.ndarray, tables: np.ndarray, base: np.ndarray, restaurant: np.ndarray, elsewhere: np.ndarray, discount: float, strength: float, rng: np.random.Generator, groups: int = GROUPS) -> np.ndarray:
    """New table counts of all dishes.

    ``restaurant`` numbers each dish's restaurant (in order), ``elsewhere`` has each restaurant's tables of dishes that are
    not in these arrays, ``base`` the parent's probability of each dish.  Dishes of one customer have one table.
    """
    tables = tables.astype(np.int64)
    total = elsewhere + np.bincount(restaurant, tables, minlength=len(elsewhere))
    open_ = np.flatnonzero(customers > 1)
    if not len(open_):
        return tables
    own = restaurant[open_]
    turn = (np.arange(len(open_)) - np.searchsorted(own, own)) % groups
    order = np.argsort(turn, kind="stable")
    log_h, bounds = np.log(base), np.searchsorted(turn[order], np.arange(groups + 1))
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        if a == b:
            continue
        dishes = open_[order[a:b]]
        c, before, at = customers[dishes], tables[dishes], restaurant[dishes]
        others, after = np.maximum(total[at] - before, 0), before.copy()
        few = c <= EXACT
        if few.any():
            after[few] = _draw_small(c[few], log_h[dishes[few]], others[few], discount, strength, rng)
        if not few.all():
            after[~few] = _draw_large(c[~few], before[~few], log_h[dishes[~few]], others[~few], discount, strength, rng)
        tables[dishes] = after
        total += np.bincount(at, after - before, minlength=len(total))
    return tables
