"""Sums, means and deviations of doubles that do not depend on the order of the rows.

A finite double is a sum of at most three whole numbers below 2**33, each times a power of 2**32. These are
summed by power as decimals, exactly and in any order; one rounding at the end gives the double next to the true sum. A
square is the sum of two doubles, its rounded value and the error of that, so deviations come from exact sums too.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType

#: Powers that stand for values without digits.
PLUS, MINUS, NAN = 1000, 1001, 1002
SHIFT = 4294967296.0


def limbs(x: Column) -> Column:
    """Array of (k, v): x is the sum of v * 2**(32 * k); infinities and NaN have powers of their own, zero and null none."""

    def of(v: Column) -> Column:
        # the logarithm may be a digit off, which only moves a bit between neighbouring powers
        parts = _bound(F.floor(F.log2(F.abs(v)) / 32).cast("int"), lambda k: _bound(v * F.pow(F.lit(2.0), (k * -16).cast("double")) * F.pow(F.lit(2.0), (k * -16).cast("double")), lambda q: _split(k, q)))
        special = F.when(F.isnan(v), NAN).when(v == math.inf, PLUS).when(v == -math.inf, MINUS)
        one = F.array(F.struct(special.cast("int").alias("k"), F.lit(1).cast("decimal(20,0)").alias("v")))
        return F.when(v.isNull() | (v == 0), F.array().cast("array<struct<k:int,v:decimal(20,0)>>")).when(F.isnan(v) | (F.abs(v) == math.inf), one).otherwise(parts)

    return _bound(x, of)


def _bound(value: Column, body) -> Column:
    """body of a value that is computed once, however often body names it."""
    return F.get(F.transform(F.array(value), body), 0)


def _whole(x: Column) -> Column:
    """x without its fraction, towards zero."""
    return x.cast("long").cast("double")


def _split(k: Column, q: Column) -> Column:
    first = _whole(q)
    rest = (q - first) * SHIFT
    second = _whole(rest)
    third = (rest - second) * SHIFT
    limb = lambda i, v: F.struct((k - i).alias("k"), v.cast("decimal(20,0)").alias("v"))
    return F.filter(F.array(limb(0, first), limb(1, second), limb(2, third)), lambda s: s["v"] != 0)


def _square(x: Column) -> list[Column]:
    """Two doubles whose sum is the square, but for values so small or large that it has no double."""
    wide = F.lit(134217729.0) * x
    high = wide - (wide - x)
    low = x - high
    return [x * x, ((high * high - x * x) + F.lit(2.0) * high * low) + low * low]


def total(parts: list[dict] | None) -> Fraction | float:
    """The exact sum of limbs, or the infinity or NaN that it is."""
    found = {p["k"]: int(p["v"]) for p in parts or ()}
    if NAN in found or PLUS in found and MINUS in found:
        return math.nan
    if PLUS in found or MINUS in found:
        return math.inf if PLUS in found else -math.inf
    return sum((Fraction(v) * Fraction(2) ** (32 * k) for k, v in found.items()), Fraction(0))


def rounded(x: Fraction | float) -> float:
    try:
        return float(x)
    except OverflowError:
        return math.inf if x > 0 else -math.inf


def _deviation(n: int, t: Fraction | float, squares: Fraction | float) -> float:
    if n == 1:
        return 0.0
    if not isinstance(t, Fraction) or not isinstance(squares, Fraction):
        return math.nan
    return math.sqrt(rounded(max(Fraction(0), (n * squares - t * t) / (n * (n - 1)))))


def _finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each group and measure: sum, mean and sample deviation (0 of a single value)."""
    for b in batches:
        sums, means, sds = [], [], []
        for n, values, squares in zip(*(b.column(c).to_pylist() for c in ("n", "x", "xx"))):
            t = total(values)
            sums.append(rounded(t) if n else None)
            means.append(sums[-1] / n if n else None)
            sds.append(_deviation(n, t, total(squares)) if n and squares is not None else None)
        names = [c for c in b.schema.names if c not in ("x", "xx")]
        cols = [b.column(c) for c in names] + [pa.array(v, pa.float64()) for v in (sums, means, sds)]
        yield pa.RecordBatch.from_arrays(cols, [*names, "sum", "mean", "sd"])


def moments(df: DataFrame, by: list[str], measures: dict[str, Column], spread: bool = False) -> DataFrame:
    """by -> for each measure its sum, mean and n (values that are not null) as ``<name>_sum``, ``<name>_mean``, ``<name>_n``, with ``spread``
    also ``<name>_sd``. A group of no values has null sums and means. Two aggregations: by group and power, then by group."""
    names = list(measures)
    rows = df.select(*[F.col(c).alias(f"by_{i}") for i, c in enumerate(by)], *[measures[m].cast("double").alias(f"m_{i}") for i, m in enumerate(names)])
    keys = [f"by_{i}" for i in range(len(by))]
    count = F.struct(F.lit(None).cast("int").alias("k"), F.lit(1).cast("decimal(20,0)").alias("v"))
    # a row for each value, so that its parts are one expression whatever the number of measures
    values = rows.select(*keys, F.explode(F.array(*[F.struct(F.lit(i).alias("m"), F.col(f"m_{i}").alias("x")) for i in range(len(names))])).alias("s")).select(*keys, "s.*")
    x = F.col("x")
    tag = lambda power, a: F.transform(a, lambda s: F.struct(F.lit(power).alias("p"), s["k"].alias("k"), s["v"].alias("v")))
    # the count of a measure is a power of its own, 0 where all are null, so that each group stands
    tagged = [tag(0, F.array(F.when(x.isNotNull(), count).otherwise(F.struct(F.lit(None).cast("int").alias("k"), F.lit(0).cast("decimal(20,0)").alias("v"))))), tag(1, limbs(x))]
    if spread:
        tagged += [tag(2, limbs(s)) for s in _square(x)]
    each = values.select(*keys, "m", F.explode(F.concat(*tagged)).alias("s")).select(*keys, "m", "s.*")
    by_power = each.groupBy(*keys, "m", "p", "k").agg(F.sum("v").alias("v"))
    held = lambda p: F.collect_list(F.when(F.col("p") == p, F.struct("k", F.col("v").cast("decimal(38,0)").alias("v"))))
    groups = by_power.groupBy(*keys, "m").agg(F.sum(F.when(F.col("p") == 0, F.col("v"))).cast("long").alias("n"), held(1).alias("x"), (held(2) if spread else F.lit(None).cast("array<struct<k:int,v:decimal(38,0)>>")).alias("xx"))
    shape = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in groups.schema if f.name not in ("x", "xx"))
    done = groups.mapInArrow(_finish, f"{shape}, sum double, mean double, sd double")
    of = lambda i, c: F.max(F.when(F.col("m") == i, F.col(c)))
    wanted = ("sum", "mean", "n", "sd") if spread else ("sum", "mean", "n")
    out = done.groupBy(*keys).agg(*[of(i, c).alias(f"{m}_{c}") for i, m in enumerate(names) for c in wanted])
    return out.withColumnsRenamed({f"by_{i}": c for i, c in enumerate(by)})


def is_double(df: DataFrame, x: Column) -> bool:
    return isinstance(df.select(x).schema[0].dataType, (DoubleType, FloatType))
