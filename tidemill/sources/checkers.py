"""Checkers and generators as outside commands or functions: what they say comes back as rows, also when they fail."""

from __future__ import annotations

import contextlib
import hashlib
import importlib
import json
import os
import signal
import subprocess
import tempfile
import time
from collections import deque
from collections.abc import Callable, Iterable, Iterator
from concurrent.futures import Future, ThreadPoolExecutor

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.operators import compliance
from tidemill.operators.rescoring import REPORT
from tidemill.operators.scoring import Tokens
from tidemill.sources.files import mock_answers

OUTCOME = "status string, reason string, report string, seconds double"
SIGNALS = REPORT + ", signals array<struct<kind: string, token: string, mark: string, headword: string>>"


Check = Callable[[str, list[str]], tuple[str, str | None, str | None]]


def _answer(line: list[str], text: str, seconds: float) -> tuple[int, str, str]:
    """Exit code, output and errors of a command; at the time limit it goes with all that it started."""
    with subprocess.Popen(line, stdin=subprocess.PIPE, stdout=subprocess.PIPE, stderr=subprocess.PIPE, text=True, start_new_session=True) as p:
        try:
            out, err = p.communicate(text, timeout=seconds)
        except BaseException:
            with contextlib.suppress(ProcessLookupError):
                os.killpg(p.pid, signal.SIGKILL)
            p.communicate()
            raise
        return p.returncode, out, err


def command(argv: list[str], allow_flag: str | None = "--allow:file", seconds: float = 120.0, calls: int = 4) -> Check:
    """A function (text, terms) -> (status, reason, report): the text goes to the command's input, the terms into a
    file behind allow_flag. An empty text is skipped as empty, a failure as an error with its reason. A task has up to
    ``calls`` calls under way."""

    def check(text: str, terms: list[str]) -> tuple[str, str | None, str | None]:
        if not text.strip():
            return "skipped", "empty", None
        with tempfile.NamedTemporaryFile("w", suffix=".txt", encoding="utf-8") as allow:
            line = list(argv)
            if terms and allow_flag:
                allow.write("".join(f"{t}\n" for t in terms))
                allow.flush()
                line += [allow_flag, allow.name]
            try:
                code, out, err = _answer(line, text, seconds)
            except subprocess.TimeoutExpired:
                return "skipped", f"error: no answer in {seconds:g} s", None
            except OSError as e:
                return "skipped", f"error: {e.strerror}", None
        if code:
            return "skipped", "error: exit {}: {}".format(code, "".join(err.strip().splitlines()[-1:])), None
        try:
            json.loads(out)
        except ValueError:
            return "skipped", "error: no JSON", None
        return "checked", None, out

    check.calls = calls
    return check


def off(_: str, __: list[str]) -> tuple[str, str | None, str | None]:
    return "skipped", "off", None


def in_order(call: Callable, items: Iterable, calls: int) -> Iterator:
    """The answers in the order of the items, with up to ``calls`` calls under way and at most as many done ahead: where
    answers are not taken, no more calls begin."""
    if calls == 1:
        yield from map(call, items)
        return
    with ThreadPoolExecutor(calls) as pool:
        waiting: deque[Future] = deque()
        try:
            for x in items:
                if len(waiting) >= 2 * calls:
                    yield waiting.popleft().result()
                waiting.append(pool.submit(call, x))
            while waiting:
                yield waiting.popleft().result()
        finally:
            for f in waiting:
                f.cancel()


def outcomes(rows: DataFrame, key: str, check: Check, calls: int | None = None) -> DataFrame:
    """rows (key, text, terms) -> key, status, reason, report, seconds. A call that fails is a row, never a failed task.

    A task has up to ``calls`` calls under way, by default what the checker says of itself, else one."""
    kind, at_once = rows.schema[key].dataType.simpleString(), getattr(check, "calls", 1) if calls is None else calls
    if at_once < 1:
        raise ValueError("calls must be 1 or more")

    def timed(row: tuple[str | None, list[str] | None]) -> tuple:
        start = time.perf_counter()
        try:
            said = check(row[0] or "", list(row[1] or []))
        except Exception as e:  # noqa: BLE001  a plug-in's failure is data
            said = ("skipped", f"error: {type(e).__name__}: {e}", None)
        return (*said, time.perf_counter() - start)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = list(in_order(timed, zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True), at_once))
            cols = [[r[k] for r in out] for k in range(4)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.string(), pa.string(), pa.float64()), strict=True)]], [key, "status", "reason", "report", "seconds"])

    return rows.select(key, "text", "terms").mapInArrow(run, f"`{key}` {kind}, {OUTCOME}")


def checker_column(checked: DataFrame, known=None, h=None) -> DataFrame:
    """Outcomes (id, status, reason, report) -> id and the checker struct of a record; known and h are the gate's."""
    read = checked.withColumn("r", F.from_json("report", REPORT)).select("id", "status", "reason", "r.*")
    empty = F.array().cast("array<struct<rule: string, kind: string, token: string, headword: string, mark: string, verb: string, sentence: int, sentences: array<int>>>")
    done = compliance.checked(read.withColumn("findings", F.coalesce("findings", empty)), known, h, keep=("status", "reason", "version", "mode"))
    only = lambda c: F.when(F.col("status") == "checked", F.col(c)).alias(c)
    struct = F.struct("status", only("ok"), F.when(F.col("status") == "checked", F.col("n_findings")).alias("findings"), only("by_kind"), only("words"), only("version"), only("mode"), only("gate_ok"), only("gate_findings"), "reason")
    return done.select("id", struct.alias("checker"))


def strict_reports(rows: DataFrame, check: Check) -> DataFrame:
    """The same for a validation, which stops at the first call that fails: run_id, seconds, findings, signals."""
    said = outcomes(rows, "run_id", check)
    report = F.when(F.col("status") == "checked", F.col("report")).otherwise(F.raise_error(F.concat(F.lit("checker: "), F.coalesce("reason", F.lit("")))))
    return said.select("run_id", "seconds", F.from_json(report, SIGNALS).alias("r")).select("run_id", "seconds", F.coalesce("r.findings", F.array()).alias("findings"), F.coalesce("r.signals", F.array()).alias("signals"))


def lookup(tokens: DataFrame, lexicon: DataFrame) -> DataFrame:
    """The senses (token, approved, names_term, noun) that a lexicon has for the tokens."""
    return lexicon.join(tokens.select(F.lower("token").alias("token")).distinct(), "token", "left_semi")


def cached(rows: DataFrame, name: str, path: str, make: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """make(rows) kept under a digest of the command's name and of all rows; equal input reads what is there.

    The digest is a sum of row hashes, so it depends neither on order nor on partitions.
    """
    spark = rows.sparkSession
    text = F.to_json(F.struct(*sorted(rows.columns)), {"ignoreNullFields": "false"})
    part = lambda k: F.sum(F.conv(F.substring(F.sha2(text, 256), k, 15), 16, 10).cast("decimal(20,0)")).cast("string")
    said = rows.agg(F.concat_ws("-", F.count("*").cast("string"), part(1), part(16), part(31))).first()[0]
    folder = f"{path}/{hashlib.sha256(f'{name} {said}'.encode()).hexdigest()[:16]}"
    if not exists(spark, f"{folder}/_SUCCESS"):
        make(rows).write.mode("overwrite").parquet(folder)
    return spark.read.parquet(folder)


def exists(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def named(spec: str) -> Callable:
    """module:function, imported."""
    module, _, name = spec.partition(":")
    return getattr(importlib.import_module(module), name)


#: Back ends by name: prompts in, prompts with text out. Others register their own function of a DataFrame.
BACKENDS: dict[str, Callable[[DataFrame], DataFrame]] = {"mock": mock_answers}


def backend(name: str) -> Callable[[DataFrame], DataFrame]:
    """A registered back end, or module:function."""
    if name in BACKENDS:
        return BACKENDS[name]
    if ":" not in name:
        raise ValueError(f"no back end {name}; known: {', '.join(sorted(BACKENDS))}, or module:function")
    return named(name)


def tokenizer(encode: Callable[[list[str]], list[list[int]]], decode: Callable[[list[list[int]]], list[str]], start: int, end: int) -> Tokens:
    """A tokenizer's batch functions and the ids of its think marks, as columns."""

    @F.arrow_udf("string")
    def decoded(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array(decode([i or [] for i in batch.to_pylist()]), pa.string())

    @F.arrow_udf("int")
    def counted(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([len(i) for i in encode([t or "" for t in batch.to_pylist()])], pa.int32())

    return Tokens(start, end, decoded, counted)


def token_counts(rows: DataFrame, column: str, encode: Callable[[list[str]], list[list[int]]], start: int | None = None, end: int | None = None) -> DataFrame:
    """rows with token ids of a text column and their number, by a tokenizer's batch function; with the ids of the think
    marks also how many ids the reasoning and the final part have."""
    @F.arrow_udf("array<bigint>")
    def ids(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array(encode([t or "" for t in batch.to_pylist()]), pa.list_(pa.int64()))

    out = rows.withColumn("token_ids", ids(F.col(column)))
    out = out.withColumn("n_tokens", F.size("token_ids"))
    if end is None:
        return out
    at, opened = F.array_position("token_ids", F.lit(end)), F.array_position("token_ids", F.lit(start if start is not None else -1))
    reasoning = F.when(at > 0, at - 1 - F.when((opened > 0) & (opened < at), opened).otherwise(0)).when(opened > 0, F.col("n_tokens") - opened).otherwise(0)
    marks = F.when(at > 0, 1).otherwise(0) + F.when((opened > 0) & ((at == 0) | (opened < at)), 1).otherwise(0)
    return out.withColumns({"reasoning_ids": reasoning.cast("int"), "final_ids": (F.col("n_tokens") - reasoning - marks).cast("int")})
