"""Distinct counts by set registers of a tunable logarithmic base.

Every identifier falls into one of m registers and draws a uniform number u; a register keeps the largest
1 + floor(-log_b(u)) of its identifiers. Registers are merged by maximum, so sketches of days, regions or files
combine into those of any union. With n identifiers the registers are independent with P(K <= k) = exp(-n/m * b^-k),
which gives the maximum likelihood estimate of n (empty registers included, so small sets need no correction), its
standard error from the curvature of the likelihood. For two sketches the joint likelihood of the pairs of registers is maximised
over all three parts (what only the left, only the right and both sets hold) together; the standard errors of union, intersection and Jaccard
similarity follow from its curvature there. A part whose likelihood is greatest at zero is held there, with the error at which
the likelihood has fallen by a factor of e.

Sizes: a group's sketch has at most m registers whatever the group's size; the first aggregation merges registers
on the map side, so a group that holds a third of all rows sends at most m rows per task.

Defined results: null identifiers are left out, and a group of only null identifiers has the estimate 0; null group values form
groups of their own; identifiers are trimmed of white space and compared without letter case, so an empty text
is one identifier; repeated rows change nothing; an empty table gives no groups; other columns may have any name.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrymill.operators.rejects import WHITESPACE

REGISTERS = 4096
BASE = 1.05


def identifier(c: Column) -> Column:
    return F.lower(F.btrim(c.cast("string"), F.lit(WHITESPACE)))


def registers(
    df: DataFrame, groups: list[str], item: Column, m: int = REGISTERS, base: float = BASE
) -> DataFrame:
    """(groups..., register, value): the sketch of every group; register -1 stands for a group's existence."""
    if m & (m - 1) or not base > 1:
        raise ValueError("the number of registers must be a power of two, and the base above 1")
    x = identifier(item)
    u = (F.shiftrightunsigned(F.xxhash64(x, F.lit(1)), 11).cast("double") + F.lit(0.5)) * F.lit(2.0**-53)
    return (
        df.select(
            *(F.col(g).alias(g) for g in groups),
            F.when(x.isNotNull(), F.xxhash64(x).bitwiseAND(F.lit(m - 1))).otherwise(-1).cast("int").alias("register"),
            F.when(x.isNotNull(), F.floor(-F.log(u) / F.lit(math.log(base))) + 1).otherwise(0).cast("int").alias("value"),
        )
        .groupBy(*groups, "register")
        .agg(F.max("value").alias("value"))
    )


def merge(sketches: DataFrame, groups: list[str]) -> DataFrame:
    """Sketches of coarser groups from those of finer ones."""
    return sketches.groupBy(*groups, "register").agg(F.max("value").alias("value"))


def log_likelihood_root(values: np.ndarray, counts: np.ndarray, base: float) -> tuple[float, float]:
    """(rate per register, its standard error) that maximises the likelihood of the register values."""
    if not values.any():
        return 0.0, 0.0
    v = values.astype(np.float64)
    a = base**-v
    d = np.where(v > 0, a * (base - 1), np.inf)

    def slopes(rate: float) -> tuple[float, float]:
        x = np.minimum(rate * d, 300.0)
        e = np.expm1(x)
        first = np.where(v > 0, np.where(np.isinf(d), 0.0, d) / e, 0.0)
        second = np.where(v > 0, np.where(np.isinf(d), 0.0, d) ** 2 * (e + 1) / e**2, 0.0)
        return float((counts * (first - a)).sum()), -float((counts * second).sum())

    t = math.log(max(float(counts.sum() / (counts * a).sum()), 1e-12))
    low, high = t - 50, t + 50
    for _ in range(100):
        rate = math.exp(t)
        f, g = slopes(rate)
        low, high = (t, high) if f > 0 else (low, t)
        step = -f / (g * rate + f) if g * rate + f < 0 else math.inf
        new = t + step if low < t + step < high else (low + high) / 2
        if abs(new - t) < 1e-12:
            break
        t = new
    rate = math.exp(t)
    _, g = slopes(rate)
    return rate, 1 / math.sqrt(-g) if g < 0 else math.inf


def estimate_one(values: np.ndarray, m: int, base: float) -> tuple[float, float]:
    """(distinct count, its standard error) from the values of the filled registers."""
    got, n = np.unique(values, return_counts=True)
    got, n = got[got > 0], n[got > 0]
    rate, error = log_likelihood_root(np.append(got, 0), np.append(n, m - n.sum()), base)
    return rate * m, error * m


class _Pairs:
    """The log-likelihood of paired register values, given the rates per register of the three disjoint parts."""

    def __init__(self, left: np.ndarray, right: np.ndarray, m: int, base: float):
        pairs, n = np.unique(np.stack([left, right]), axis=1, return_counts=True)
        k, l = pairs.astype(np.float64)
        self.n, self.rest = n.astype(np.float64), m - float(n.sum())
        self.lower, self.upper, self.same = k > l, k < l, k == l
        at = lambda v: (base**-v, np.where(v > 0, base ** -(v - 1), np.inf))
        self.k, self.l = at(k), at(l)

    @staticmethod
    def _is(rate: float, bounds: tuple, pick: np.ndarray) -> np.ndarray:
        """The chance that a part's register has the value with these bounds (a value of 0: that it is empty)."""
        low, high = bounds[0][pick], bounds[1][pick]
        gap = np.where(np.isinf(high), 0.0, high - low)
        return np.exp(-rate * low) * np.where(np.isinf(high), 1.0, -np.expm1(-rate * gap))

    @staticmethod
    def _below(rate: float, bounds: tuple, pick: np.ndarray) -> np.ndarray:
        high = bounds[1][pick]
        return np.where(np.isinf(high), 0.0, np.exp(-rate * np.where(np.isinf(high), 0.0, high)))

    def __call__(self, rates: np.ndarray) -> float:
        a, b, c = np.maximum(rates, 0.0)
        p = np.empty(len(self.n))
        x = self.lower  # the left register is greater, so the left part alone made it
        p[x] = self._is(a, self.k, x) * self._is(b + c, self.l, x)
        x = self.upper
        p[x] = self._is(b, self.l, x) * self._is(a + c, self.k, x)
        x = self.same  # the common part made it, or both others did while the common part stayed below
        upto = np.exp(-(a + b) * self.k[0][x])
        p[x] = self._is(c, self.k, x) * upto + self._below(c, self.k, x) * self._is(a, self.k, x) * self._is(b, self.k, x)
        return float((self.n * np.log(np.maximum(p, 1e-300))).sum()) - self.rest * (a + b + c)


def _climb(f, x: np.ndarray, steps: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(gradient, Hessian, f(x)) by differences; a coordinate next to its lower bound is moved off it first."""
    x = np.maximum(x, low + steps)
    d, e = len(x), np.diag(steps)
    mid = f(x)
    up, down = np.array([f(x + e[i]) for i in range(d)]), np.array([f(x - e[i]) for i in range(d)])
    hess = np.diag((up - 2 * mid + down) / steps**2)
    for i in range(d):
        for j in range(i):
            both = f(x + e[i] + e[j]) - f(x + e[i] - e[j]) - f(x - e[i] + e[j]) + f(x - e[i] - e[j])
            hess[i, j] = hess[j, i] = both / (4 * steps[i] * steps[j])
    return (up - down) / (2 * steps), hess, x


JOINT = ("left_count", "right_count", "both", "both_error", "either", "either_error", "jaccard", "jaccard_error")


def estimate_joint(left: np.ndarray, right: np.ndarray, m: int, base: float) -> dict[str, float]:
    """Sizes of both sets, union, intersection and Jaccard similarity with their standard errors, from paired register values (0: empty)."""
    nu, _ = estimate_one(left, m, base)
    nv, _ = estimate_one(right, m, base)
    if min(nu, nv) <= 0:
        (u, eu), (v, ev) = estimate_one(left, m, base), estimate_one(right, m, base)
        return dict(zip(JOINT, (u, v, 0.0, 0.0, u + v, max(eu, ev), 0.0, 0.0)))
    f, total = _Pairs(left, right, m, base), (nu + nv) / m
    # a start: the common part that fits best given the sizes by themselves
    grid = np.linspace(0, 1, 41) * min(nu, nv) / m
    best = max(grid, key=lambda c: f(np.array([nu / m - c, nv / m - c, c])))
    x = np.array([nu / m - best, nv / m - best, best])
    low, least = np.zeros(3), 1e-7 * total
    value = f(x)
    for _ in range(40):
        steps = np.maximum(1e-3 * x, 1e-5 * total)
        slope, hess, _ = _climb(f, x, steps, low)
        free = (x > least) | (slope > 0)
        move = np.zeros(3)
        if free.any():
            h = hess[np.ix_(free, free)]
            vals, vecs = np.linalg.eigh(h)
            vals = np.minimum(vals, -1e-9 * max(1e-12, float(np.abs(vals).max())))  # uphill also where the surface is not concave
            move[free] = -vecs @ ((vecs.T @ slope[free]) / vals)
        scale, done = 1.0, True
        for _ in range(30):
            new = np.maximum(x + scale * move, 0.0)
            got = f(new)
            if got > value + 1e-9:
                done, x, value = got - value < 1e-7, new, got
                break
            scale /= 2
        if done:
            break
    steps = np.maximum(1e-3 * x, 1e-5 * total)
    slope, hess, _ = _climb(f, x, steps, low)
    free = x > least
    cov = np.zeros((3, 3))
    if free.any():
        vals, vecs = np.linalg.eigh(hess[np.ix_(free, free)])
        cov[np.ix_(free, free)] = (vecs / np.maximum(-vals, 1e-12)) @ vecs.T
    for i in np.flatnonzero(~free):
        cov[i, i] = 1 / max(abs(float(slope[i])), 1e-12) ** 2
    a, b, c = x * m
    cov *= m * m
    union = a + b + c
    error = lambda g: float(np.sqrt(max(0.0, g @ cov @ g)))
    jaccard = np.array([-c / union**2, -c / union**2, (a + b) / union**2])
    return dict(zip(JOINT, (a + c, b + c, c, error(np.array([0, 0, 1])), union, error(np.ones(3)), c / union, error(jaccard))))


def estimates(sketches: DataFrame, groups: list[str], m: int = REGISTERS, base: float = BASE) -> DataFrame:
    """Per group: estimate, its standard error and the bounds of two standard errors."""
    schema = sketches.select(*groups).schema
    names = [f.name for f in schema]
    packed = sketches.groupBy(*groups).agg(F.collect_list("value").alias("values"))

    def solve(batches: Iterable) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            found = [estimate_one(np.asarray(x, dtype=np.int64), m, base) for x in batch.column(len(names)).to_pylist()]
            est, err = [x for x, _ in found], [x for _, x in found]
            yield pa.record_batch(
                [
                    *(batch.column(k) for k in range(len(names))),
                    pa.array(est, pa.float64()),
                    pa.array(err, pa.float64()),
                    pa.array([max(0.0, e - 2 * s) for e, s in found], pa.float64()),
                    pa.array([e + 2 * s for e, s in found], pa.float64()),
                ],
                names=[*names, "estimate", "standard_error", "low", "high"],
            )

    out = schema
    for c in ("estimate", "standard_error", "low", "high"):
        out = out.add(c, "double")
    return packed.mapInArrow(solve, out)


def joint(pairs: DataFrame, groups: list[str], m: int = REGISTERS, base: float = BASE) -> DataFrame:
    """Per group of paired registers (left_value, right_value; 0 where empty): sizes, overlap and similarity."""
    names = [f.name for f in pairs.select(*groups).schema]
    packed = pairs.groupBy(*groups).agg(
        F.collect_list("left_value").alias("left_values"), F.collect_list("right_value").alias("right_values")
    )
    keys = JOINT

    def solve(batches: Iterable) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            left, right = batch.column(len(names)).to_pylist(), batch.column(len(names) + 1).to_pylist()
            found = [estimate_joint(np.asarray(a), np.asarray(b), m, base) for a, b in zip(left, right)]
            yield pa.record_batch(
                [*(batch.column(k) for k in range(len(names))), *(pa.array([f[k] for f in found], pa.float64()) for k in keys)],
                names=[*names, *keys],
            )

    out = pairs.select(*groups).schema
    for c in keys:
        out = out.add(c, "double")
    return packed.mapInArrow(solve, out)


def pair_up(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """Registers of two sketches side by side; a register that one of them lacks is 0."""
    a = left.where("register >= 0").withColumnRenamed("value", "left_value")
    b = right.where("register >= 0").withColumnRenamed("value", "right_value")
    return a.join(b, [*on, "register"], "full_outer").na.fill(0, ["left_value", "right_value"])
