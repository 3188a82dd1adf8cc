"""The normal distribution as column expressions."""

from __future__ import annotations

import math
from statistics import NormalDist

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Terms of the series of the distribution function for values of up to FAR, and of the continued fraction beyond.
TERMS, FAR, FRACTION = 60, 3.0, 120
#: A first guess of the quantile, good to 4.5e-4 (Abramowitz and Stegun 26.2.23).
GUESS_ABOVE, GUESS_BELOW = (2.515517, 0.802853, 0.010328), (1.0, 1.432788, 0.189269, 0.001308)


def _bound(value: Column, body) -> Column:
    """body of a value that is computed once, however often body names it."""
    return F.get(F.transform(F.array(value), body), 0)


def density(x: Column) -> Column:
    return F.exp(-x * x / 2.0) / F.lit(math.sqrt(2 * math.pi))


def cdf(x: Column) -> Column:
    """1/2 and the density times x + x**3/3 + x**5/(3*5) + ...; in the tails the density by the continued fraction
    x + 1/(x + 2/(x + ...)), which keeps their relative precision. Null of null and NaN of NaN."""

    def series(v: Column) -> Column:
        start = F.struct(v.alias("term"), v.alias("sum"))
        step = lambda s, k: F.struct((s["term"] * v * v / (2.0 * k + 1)).alias("term"), (s["sum"] + s["term"] * v * v / (2.0 * k + 1)).alias("sum"))
        total = F.aggregate(F.sequence(F.lit(1), F.lit(TERMS)), start, step, lambda s: s["sum"])
        return 0.5 + density(v) * total

    def tail(v: Column) -> Column:
        inner = F.aggregate(F.sequence(F.lit(FRACTION), F.lit(1), F.lit(-1)), F.lit(0.0), lambda f, k: k / (F.abs(v) + f))
        return density(v) / (F.abs(v) + inner)

    def whole(v: Column) -> Column:
        return F.when(F.isnan(v), v).when(v > FAR, 1.0 - tail(v)).when(v < -FAR, tail(v)).otherwise(series(v))

    return _bound(x.cast("double"), whole)


def _poly(x: Column, factors: tuple[float, ...]) -> Column:
    out = F.lit(factors[-1])
    for c in reversed(factors[:-1]):
        out = out * x + c
    return out


def quantile(p: Column | float, steps: int = 3) -> Column:
    """The value below which a share p lies: a rational guess and Newton's method with its second-order term. Null outside 0 to 1.

    Spark does not fold the series of a literal, so a share that all rows have is given as a number, whose value is a literal."""
    if not isinstance(p, Column):
        return F.lit(NormalDist().inv_cdf(p) if 0 < p < 1 else None).cast("double")

    def guess(q: Column) -> Column:
        tail = F.least(q, 1.0 - q)
        t = F.sqrt(-2.0 * F.log(tail))
        size = _bound(t, lambda v: v - _poly(v, GUESS_ABOVE) / _poly(v, GUESS_BELOW))
        return F.when((q <= 0) | (q >= 1) | F.isnan(q), None).when(q < 0.5, -size).otherwise(size)

    def better(x: Column, q: Column) -> Column:
        return _bound(x, lambda v: _bound((cdf(v) - q) / density(v), lambda e: v - e / (1.0 + v * e / 2.0)))

    def solve(q: Column) -> Column:
        x = guess(q)
        for _ in range(steps):
            x = better(x, q)
        return x

    return _bound(p.cast("double"), solve)
