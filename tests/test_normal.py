"""The normal distribution's columns against the standard library."""

from statistics import NormalDist

import pytest
from pyspark.sql import functions as F

from tidemill.functions import normal
from tidemill.operators import stats

N = NormalDist()


def test_distribution_and_quantile(spark):
    xs = [k / 7 for k in range(-60, 61)] + [-30.0, 30.0, 0.0, 3.0, -3.0]
    for r in spark.createDataFrame([(x,) for x in xs], "x double").select("x", normal.cdf(F.col("x")).alias("c")).collect():
        assert r.c == pytest.approx(N.cdf(r.x), abs=1e-15, rel=1e-9 if r.x > -7 else 1)
    ps = [1e-12, 1e-9, 1e-5, 0.001, 0.0125 / 2, 0.02, 0.3, 0.5, 0.8, 0.99, 0.99999]
    for r in spark.createDataFrame([(p,) for p in ps], "p double").select("p", normal.quantile(F.col("p")).alias("q")).collect():
        assert r.q == pytest.approx(N.inv_cdf(r.p), abs=2e-11 if r.p > 0.9999 else 1e-12)


def test_edges(spark):
    rows = spark.createDataFrame([(None,), (float("nan"),), (0.0,), (1.0,), (-1.0,)], "x double")
    got = [tuple(r) for r in rows.select(normal.cdf(F.col("x")), normal.quantile(F.col("x"))).collect()]
    assert got[0] == (None, None) and got[1][0] != got[1][0] and [q for _, q in got[1:]] == [None] * 4


def test_designs(spark):
    rows = spark.createDataFrame([(0.95, 0.5, 0.10, 0.05 / 4, 0.8, 200, 0.08, 0.03), (0.5, 0.0, 0.02, 0.05, 0.9, 50, 0.2, 0.2)], "sd double, rho double, effect double, alpha double, power double, n int, a double, b double")
    c = F.col
    for r in rows.select("*", stats.pairs_needed_column(c("sd"), c("rho"), c("effect"), c("alpha"), c("power")).alias("k"), stats.discordance_power_column(c("n"), c("a"), c("b"), c("alpha")).alias("w")).collect():
        assert r.k == stats.pairs_needed(r.sd, r.rho, r.effect, r.alpha, r.power)
        assert r.w == pytest.approx(stats.discordance_power(r.n, r.a, r.b, r.alpha), abs=1e-12)
    assert rows.select(stats.pairs_needed_column(c("sd"), c("rho"), c("effect"), c("alpha"), c("power")).alias("k")).first().k == 1108


def test_levels_of_all_designs_are_solved_once(spark):
    rows = spark.range(1, 400).select((F.col("id") / 400).alias("sd"), (F.col("id") % 7 / 8).alias("rho"), (F.col("id") % 11 / 20 + 0.01).alias("effect"))
    got = rows.withColumn("k", stats.pairs_needed_column(F.col("sd"), F.col("rho"), F.col("effect"), 0.0125, 0.8))
    assert "lambda" not in got._jdf.queryExecution().optimizedPlan().toString()
    assert all(r.k == stats.pairs_needed(r.sd, r.rho, r.effect, 0.0125, 0.8) for r in got.collect())
    assert spark.range(1).select(normal.quantile(1.0)).first()[0] is None
