"""Statistics of arm records: per sample, spread over samples, cost against the baseline arm, power."""

from __future__ import annotations

import math
from functools import reduce
from statistics import NormalDist

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemill.functions import exact, normal

MEASURES = ("accuracy", "reasoning", "generated", "output", "latency", "compliance", "checker_ok", "gate_ok", "findings")
COUNTS = ("n", "n_scored", "no_line", "fallback_hits", "n_truncated", "n_degenerate", "n_checked")


def task_counts(tasks: DataFrame, *by: str) -> DataFrame:
    return tasks.groupBy(*by).agg(F.count("*").alias("n"))


def per_sample(records: DataFrame) -> DataFrame:
    """arm, sample -> counts and means. Accuracy leaves out unscored and truncated records; the checker's means
    are over checked records, gate_ok over those with a gate. Records without a checker column count as unchecked.

    Means do not depend on the order of the rows: whole numbers and flags are summed as such, doubles exactly."""
    if "checker" not in records.columns:
        records = records.withColumn("checker", F.lit(None).cast("struct<status: string, ok: boolean, findings: int, gate_ok: boolean>"))
    checked = F.coalesce(F.col("checker.status") == "checked", F.lit(False))
    scored = F.col("correct").isNotNull() & ~F.col("truncated")
    of_checked = lambda c: F.when(checked, F.col(c))
    measured = {
        "accuracy": F.when(scored, F.col("correct")), "reasoning": F.col("reasoning_tokens"), "generated": F.col("generated_tokens"), "output": F.col("output_tokens"),
        "latency": F.col("latency_s"), "compliance": F.col("compliance"), "checker_ok": of_checked("checker.ok"), "gate_ok": of_checked("checker.gate_ok"), "findings": of_checked("checker.findings"),
    }
    doubles = {m: F.when(~F.isnan(c), c) for m, c in measured.items() if exact.is_double(records, c)}
    mean = lambda c: F.try_divide(F.sum(c.cast("long")).cast("double"), F.count(c))
    out = records.groupBy("arm", "sample").agg(
        F.count("*").alias("n"), F.count_if(scored).alias("n_scored"),
        F.count("fallback_correct").alias("no_line"), F.count_if("fallback_correct").alias("fallback_hits"), F.count_if("truncated").alias("n_truncated"), F.count_if("degenerate").alias("n_degenerate"),
        F.count_if(checked).alias("n_checked"), *[mean(c).alias(m) for m, c in measured.items() if m not in doubles],
    )
    return _beside(out, ["arm", "sample"], exact.moments(records, ["arm", "sample"], doubles).withColumnsRenamed({f"{m}_mean": m for m in doubles}) if doubles else None, [*doubles])


def _beside(groups: DataFrame, by: list[str], more: DataFrame | None, names: list[str]) -> DataFrame:
    """groups with the named columns of more, a row for each of the same groups."""
    if more is None:
        return groups
    renamed = more.select(*[F.col(c).alias(f"more_{c}") for c in by], *names)
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"more_{c}")) for c in by])
    return groups.join(renamed, same, "left").drop(*[f"more_{c}" for c in by])


def spread(samples: DataFrame) -> DataFrame:
    """arm -> mean and sample deviation of the samples' means (0 for a single one), counts summed."""
    sums = [F.sum(c).alias(c) for c in COUNTS]
    arms = samples.groupBy("arm").agg(F.countDistinct("sample").alias("k"), *sums)
    means = exact.moments(samples, ["arm"], {m: F.col(m) for m in MEASURES}, spread=True).withColumnsRenamed({f"{m}_mean": m for m in MEASURES})
    return _beside(arms, ["arm"], means, [c for m in MEASURES for c in (m, f"{m}_sd")])


def tax(arms: DataFrame, base: str = "A0") -> DataFrame:
    """Each other arm against the baseline: differences of accuracy, compliance, the checker's means and of reasoning,
    ratios of cost; no baseline, no rows.

    The baseline is one row, so the join carries a row of fixed size to each arm.
    """
    zero = arms.filter(F.col("arm") == base).select(*[F.col(m).alias(f"base_{m}") for m in MEASURES])
    ratio = [F.try_divide(F.col(m), F.col(f"base_{m}")).alias(f"{m}_ratio") for m in MEASURES[1:5]]
    diff = [(F.col(m) - F.col(f"base_{m}")).alias(f"{m}_diff") for m in ("accuracy", "reasoning", "compliance", "checker_ok", "gate_ok")]
    return arms.filter(F.col("arm") != base).join(F.broadcast(zero.limit(1)), F.lit(True)).select("arm", *diff, *ratio)


def summary_lines(arms: DataFrame, taxes: DataFrame) -> list[str]:
    """The text summary: one line for each arm and each tax; at most a handful of rows by construction."""
    show = lambda x, sign="": "n/a" if x is None else f"{x:{sign}.3f}"
    out = []
    for r in arms.orderBy("arm").collect():
        means = " ".join(f"{m}={show(r[m])}±{show(r[f'{m}_sd'])}" for m in MEASURES)
        out.append(f"{r.arm}: k={r.k} n={r.n} {means} no_line={r.no_line} fallback_hits={r.fallback_hits} checked={r.n_checked} degenerate={r.n_degenerate} truncated={r.n_truncated}")
    for r in taxes.orderBy("arm").collect():
        diffs = ", ".join(f"{m} {show(r[f'{m}_diff'], '+')}" for m in ("accuracy", "reasoning", "compliance", "checker_ok", "gate_ok"))
        out.append(f"{r.arm} vs base: {diffs}, " + ", ".join(f"{m} x{show(r[f'{m}_ratio'])}" for m in ("generated", "output", "latency")))
    return out


def pairs_needed(sd: float, rho: float, effect: float, alpha: float, power: float) -> int:
    """Tasks that show a relative difference of paired costs."""
    z = NormalDist().inv_cdf(1 - alpha / 2) + NormalDist().inv_cdf(power)
    return math.ceil((z * sd * math.sqrt(2 * (1 - rho)) / math.log1p(effect)) ** 2)


def pairs_needed_column(sd: Column, rho: Column, effect: Column, alpha: Column | float, power: Column | float) -> Column:
    """``pairs_needed`` of a table of designs; levels that all designs have are given as numbers."""
    z = normal.quantile(1.0 - alpha / 2.0) + normal.quantile(power)
    return F.ceil(F.pow(z * sd * F.sqrt(2.0 * (1.0 - rho)) / F.log1p(effect), F.lit(2.0))).cast("long")


def discordance_power_column(n: Column, p10: Column, p01: Column, alpha: Column | float) -> Column:
    """``discordance_power`` of a table of designs, alpha as there; null where no pair is discordant."""
    both, gap = p10 + p01, p10 - p01
    z = normal.quantile(1.0 - alpha / 2.0)
    return normal.cdf(F.try_divide(F.abs(gap) * F.sqrt(n) - z * F.sqrt(both), F.sqrt(both - gap * gap)))


def z_statistic(greens: Column, scored: Column, gamma: float) -> Column:
    g = F.lit(gamma)
    return F.when(scored == 0, F.lit(0.0)).otherwise((greens - g * scored) / F.sqrt(scored * g * (1 - g)))


def discordance_power(n: int, p10: float, p01: float, alpha: float) -> float:
    """Power of a test of paired proportions with the given discordant rates, normal approximation."""
    both, gap = p10 + p01, p10 - p01
    z = NormalDist().inv_cdf(1 - alpha / 2)
    return NormalDist().cdf((abs(gap) * math.sqrt(n) - z * math.sqrt(both)) / math.sqrt(both - gap**2))
