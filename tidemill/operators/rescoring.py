"""A finished run checked after the fact: records whose check was skipped get one, the others stay."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemill.operators import compliance
from tidemill.operators.scoring import allowed_terms

KEYS = ("task_id", "arm", "sample")
REPORT = "version string, mode string, ok boolean, findings array<struct<rule: string, kind: string, token: string, headword: string, mark: string, verb: string, sentence: int, sentences: array<int>>>"


def waiting(checker: Column) -> Column:
    """A check that was skipped for another reason than an empty text."""
    return F.coalesce((checker["status"] == "skipped") & ~checker["reason"].eqNullSafe(F.lit("empty")), F.lit(False))


def changed_files(then: DataFrame, now: DataFrame) -> DataFrame:
    """path, digest of two times -> the paths whose digests differ or that only one of them has."""
    a, b = (d.select(F.col("path").alias(p), F.col("digest").alias(q)) for d, p, q in ((then, "p", "x"), (now, "q", "y")))
    return a.join(b, F.col("p") == F.col("q"), "full_outer").filter(~F.col("x").eqNullSafe(F.col("y"))).select(F.coalesce("p", "q").alias("path"))


def rescored(records: DataFrame, tasks: DataFrame, checker: Callable) -> DataFrame:
    """Records with the checker's outcome where they wait for one; a record without a report still waits.

    ``checker`` takes batches of task_id, arm, sample, text, terms and gives batches of task_id, arm,
    sample, report (JSON). Only waiting records reach it; running it again changes nothing.
    """
    terms = tasks.select(F.col("id").alias("task_id"), allowed_terms(F.col("kind"), F.coalesce("technical_terms", F.array().cast("array<string>"))).alias("terms"))
    sent = records.filter(waiting(F.col("checker"))).select(*KEYS, F.coalesce("text", F.lit("")).alias("text")).join(terms, "task_id", "left")
    sent = sent.select(*KEYS, "text", F.coalesce("terms", F.array().cast("array<string>")).alias("terms"))
    reports = sent.mapInPandas(checker, "task_id string, arm string, sample int, report string")
    read = reports.select(F.struct(*KEYS).alias("id"), F.from_json("report", REPORT).alias("r")).filter("r.findings IS NOT NULL").select("id", "r.*")
    done = compliance.checked(read, keep=("version", "mode"))
    fresh = F.struct(
        F.lit("checked").alias("status"), "ok", F.col("n_findings").alias("findings"), "by_kind", "words", "version", "mode", "gate_ok", "gate_findings", F.lit(None).cast("string").alias("reason"),
    )
    done = done.select("id.*", fresh.alias("fresh"))
    return records.join(done, list(KEYS), "left").withColumn("checker", F.coalesce("fresh", "checker")).select(*records.columns)
