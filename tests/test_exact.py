"""Sums, means and deviations of doubles against exact arithmetic, under any partitioning."""

import math
import random
import statistics

import pytest
from pyspark.sql import functions as F

from tidemill.functions import exact
from tidemill.operators import reviews, stats


def _rows():
    rng, rows = random.Random(1), []
    for g in ("a", "b", None, "wide", "tiny"):
        for _ in range(200):
            e = rng.choice([0, 10, -30, 60]) if g != "wide" else rng.randrange(-1074, 1000)
            rows.append((g, rng.choice([None, 0.0, math.ldexp(rng.uniform(-1, 1), e)]), 5e-324 if g == "tiny" else rng.uniform(0, 1)))
    return rows + [("inf", math.inf, 1.0), ("inf", 1.0, 2.0), ("both", math.inf, 1.0), ("both", -math.inf, 1.0), ("nan", math.nan, 1.0), ("none", None, None), ("over", 1e308, 3.5), ("over", 1e308, 3.5)]


def test_moments_are_exact_and_do_not_depend_on_the_split(spark):
    rows, seen = _rows(), set()
    for n in (1, 3, 7, 64):
        df = spark.createDataFrame(rows, "g string, x double, y double").repartition(n)
        got = exact.moments(df, ["g"], {"x": F.col("x"), "y": F.col("y")}, spread=True).collect()
        seen.add(tuple(sorted(map(repr, got))))
    assert len(seen) == 1
    for r in got:
        for i, c in enumerate(("x", "y"), 1):
            values = [v[i] for v in rows if v[0] == r.g and v[i] is not None]
            assert r[f"{c}_n"] == len(values)
            if not values:
                assert r[f"{c}_sum"] is r[f"{c}_mean"] is r[f"{c}_sd"] is None
                continue
            try:
                want = math.fsum(values)
            except OverflowError:
                want = math.inf
            except ValueError:
                want = math.nan
            assert repr(r[f"{c}_sum"]) == repr(want)
            if r.g in ("a", "b", None, "tiny") or c == "y":
                assert r[f"{c}_mean"] == pytest.approx(want / len(values), rel=1e-15)
                assert r[f"{c}_sd"] == pytest.approx(statistics.stdev(values) if len(values) > 1 else 0.0, rel=1e-12, abs=1e-300)


def test_without_groups_and_empty(spark):
    df = spark.createDataFrame([(0.1,)] * 10 + [(1e16,), (-1e16,)], "x double")
    (r,) = exact.moments(df, [], {"x": F.col("x")}).collect()
    assert r.x_sum == math.fsum([0.1] * 10) and r.x_n == 12
    assert exact.moments(df.filter("x > 1e17").withColumn("g", F.lit(1)), ["g"], {"x": F.col("x")}).count() == 0
    (t,) = reviews.timing(df.withColumnRenamed("x", "seconds")).collect()
    assert (t.runs, t.most, t["mean"]) == (12, 1e16, math.fsum([0.1] * 10) / 12)


def test_summary_does_not_depend_on_the_split(spark):
    rng = random.Random(6)
    rows = [(f"A{i % 3}", (i // 3) % 4, rng.random() < 0.5, None, False, False, rng.randrange(9), rng.randrange(9), rng.randrange(9), rng.random() * 10 ** rng.randrange(-9, 9), rng.random()) for i in range(600)]
    row = "arm string, sample int, correct boolean, fallback_correct boolean, truncated boolean, degenerate boolean, reasoning_tokens int, generated_tokens int, output_tokens int, latency_s double, compliance double"
    seen = set()
    for n in (1, 3, 7, 64):
        arms = stats.spread(stats.per_sample(spark.createDataFrame(rows, row).repartition(n)))
        seen.add((tuple(sorted(map(repr, arms.collect()))), tuple(sorted(map(repr, stats.tax(arms).collect())))))
    assert len(seen) == 1
    means = [statistics.fmean(r[9] for r in rows if r[0] == "A1" and r[1] == s) for s in range(4)]
    (a,) = arms.filter("arm = 'A1'").collect()
    assert a.latency == statistics.fmean(means) and a.latency_sd == pytest.approx(statistics.stdev(means), rel=1e-14)
