"""Task and record files: JSON lines in, JSON lines and digests out."""

from __future__ import annotations

import datetime
import json
import random
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.functions.text import PLAIN_NUMBER
from tidemill.operators.scan import cut
from tidemill.operators.validation import duplicates, gold_number, task_errors, undated_single

TASK = "id string, kind string, prompt string, technical_terms array<string>, source string, split string, license string"
RECORD = (
    "task_id string, kind string, arm string, sample int, model string, backend string, text string, correct boolean, fallback_correct boolean, degenerate boolean, truncated boolean, "
    "reasoning_tokens int, generated_tokens int, output_tokens int, latency_s double, compliance double, nonconforming array<string>, "
    "checker struct<status: string, ok: boolean, findings: int, by_kind: map<string,int>, words: array<string>, version: string, mode: string, gate_ok: boolean, gate_findings: int, reason: string>, "
    "rewrite struct<draft_text: string, draft_correct: boolean, draft_generated_tokens: int, draft_reasoning_tokens: int, rewrite_generated_tokens: int, rewrite_reasoning_tokens: int>"
)


#: A text watermark's record.
WATERMARK = "task string, arm string, tokens long, greens long, z_full double, matched_len long, z_matched double"
#: The main task file and the folder of further ones, below a root.
MAIN_TASKS, MORE_TASKS = "tasks.jsonl", "tasks/*.jsonl"


#: A lexicon file.
LEXICON = (
    "approved array<struct<id: string, word: string, pos: string, forms: array<string>, plural: string>>, "
    "unapproved array<struct<word: string, pos: string, qualifier: string, forms: array<string>, "
    "alternatives: array<struct<ref: string, form: string, stated_pos: string, phrase: string, unresolved: string>>, note: string, help: string>>"
)


class TaskError(ValueError):
    """The violations of a load, one line each, and how many more there are; ``violations`` has them all."""

    def __init__(self, text: str, violations: DataFrame) -> None:
        super().__init__(text)
        self.violations = violations


def _paths(spark: SparkSession, pattern: str) -> list[str]:
    """Paths that a pattern names, on whatever file system it is."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(pattern)
    found = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(path)
    return sorted(_plain(f.getPath().toString()) for f in found or [] if f.isFile())


def _plain(path: str) -> str:
    return "/" + path.removeprefix("file:").lstrip("/") if path.startswith("file:") else path


def expand(spark: SparkSession, patterns: list[str]) -> list[str]:
    """Paths in the order of the patterns, then by name, each once; a pattern without a match is an error."""
    out: dict[str, None] = {}
    for p in patterns:
        found = _paths(spark, p)
        if not found:
            raise FileNotFoundError(p)
        out.update(dict.fromkeys(found))
    return list(out)


def default_tasks(spark: SparkSession, root: str = ".") -> list[str]:
    """The main task file first, where there is one, then the others by name."""
    return [*_paths(spark, f"{root}/{MAIN_TASKS}"), *_paths(spark, f"{root}/{MORE_TASKS}")]


def shown(path: Column, root: str) -> Column:
    """A path below the root as it stands below it, any other as a whole."""
    base = root.rstrip("/") + "/"
    return F.when(F.startswith(path, F.lit(base)), F.substring(path, F.lit(len(base) + 1), F.length(path))).otherwise(path)


def lines(spark: SparkSession, paths: list[str]) -> DataFrame:
    """file, file_pos, line_no, value: every line that is not blank, numbered with the blank ones.

    A file is read split by split: a first pass over the splits counts their lines, so a line's number is
    its place in its split and the lines of the splits before. A row for each split reaches the driver."""
    if not paths:
        raise ValueError("no task files")
    order = F.array(*[F.lit(p) for p in paths])
    path = F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))
    raw = spark.read.option("lineSep", "\n").text(paths).select(
        F.regexp_replace(path, "^file:/*", "/").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), F.regexp_replace("value", "\r$", "").alias("value")
    )
    splits = raw.groupBy("file", "block").agg(F.min("at").alias("first"), F.count("*").alias("n")).collect()
    starts, before = [], dict.fromkeys(paths, 0)
    for s in sorted(splits, key=lambda s: (s.file, s.block)):
        starts.append((s.file, s.block, before[s.file] + 1 - s.first))
        before[s.file] += s.n
    shift = spark.createDataFrame(starts, "file string, block long, shift long")
    numbered = raw.join(F.broadcast(shift), ["file", "block"]).withColumn("line_no", F.col("at") + F.col("shift"))
    return numbered.select("file", F.array_position(order, F.col("file")).alias("file_pos"), "line_no", "value").filter("trim(value) <> ''")


def load_tasks(spark: SparkSession, patterns: list[str], max_shown: int = 1000, root: str | None = None) -> DataFrame:
    """Tasks of all files. Every violation and every repeated id of all files is in one error, which shows
    max_shown of them, says how many more there are and carries them all as a table."""
    spark.conf.set("spark.sql.variant.allowDuplicateKeys", "true")
    file = shown(F.col("file"), root) if root else F.col("file")
    raw = lines(spark, expand(spark, patterns)).withColumn("where", F.concat_ws(":", file, "line_no")).withColumn("errors", task_errors(F.col("value")))
    bad = raw.select("file_pos", "line_no", F.explode("errors").alias("e"), "where").select("file_pos", "line_no", F.concat_ws(": ", "where", "e").alias("said"))
    good = raw.filter(F.size("errors") == 0).withColumn("id", F.get_json_object("value", "$.id"))
    again = duplicates(good).select(F.lit(1 << 30).alias("file_pos"), F.lit(0).alias("line_no"), F.concat(F.col("where"), F.lit(": id "), "id", F.lit(" is first at "), "first_where").alias("said"))
    every = bad.unionByName(again)
    first = every.orderBy("file_pos", "line_no", "said").limit(max_shown).collect()
    if first:
        more = every.count() - len(first) if len(first) == max_shown else 0
        raise TaskError("\n".join([r.said for r in first] + ([f"and {more} more"] if more else [])), every)
    parsed = good.withColumn("t", F.from_json("value", TASK)).select("file_pos", "line_no", "t.*", F.get_json_object("value", "$.answer").alias("answer"))
    return parsed.select("*", F.when(F.col("kind") == "math", F.col("answer").cast("double")).alias("answer_num"), F.when(F.col("kind") == "qa", F.col("answer")).alias("answer_str")).drop("answer")


#: An entry of a dictionary file.
ENTRY = "word: string, pos: string, qualifier: string, status: struct<kind: string>, forms: array<string>, ste_example: string, nonste_example: string"


def read_entries(spark: SparkSession, path: str) -> DataFrame:
    """The entries of a dictionary file, with ``approved`` from their status."""
    raw = spark.read.option("multiLine", True).schema(f"entries array<struct<{ENTRY}>>").json(path)
    return raw.select(F.inline("entries")).withColumns({"approved": F.col("status.kind") == "approved", "forms": F.coalesce("forms", F.array().cast("array<string>"))}).drop("status")


def read_records(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(RECORD).option("recursiveFileLookup", True).json(path).withColumn("sample", F.coalesce("sample", F.lit(0)))


def read_manifest(spark: SparkSession, run: str) -> dict:
    return json.loads(spark.read.text(f"{run}/manifest").first()[0])


def write_manifest(spark: SparkSession, manifest: dict, path: str, mode: str = "errorifexists") -> None:
    spark.createDataFrame([(json.dumps(manifest),)], "value string").coalesce(1).write.mode(mode).text(path)


def read_lexicon(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Approved and unapproved entries of a lexicon file."""
    raw = spark.read.option("multiLine", True).schema(LEXICON).json(path)
    return raw.select(F.inline("approved")), raw.select(F.inline("unapproved"))


def read_attested(spark: SparkSession, path: str) -> DataFrame:
    """token of a gate file: the attested words."""
    return spark.read.option("multiLine", True).schema("h array<string>").json(path).select(F.explode("h").alias("token"))


def write_records(records: DataFrame, path: str) -> None:
    """A new folder or an error; the committer makes the files appear at once."""
    records.write.mode("errorifexists").option("ignoreNullFields", False).json(path)


def write_tasks(tasks: DataFrame, path: str) -> None:
    """One deterministic JSON-lines file."""
    tasks.coalesce(1).sortWithinPartitions("id").select(F.to_json(F.struct(*tasks.columns)).alias("value")).write.mode("errorifexists").text(path)


def digests(spark: SparkSession, paths: list[str]) -> DataFrame:
    """path, bytes, digest of each file."""
    return spark.read.format("binaryFile").load(paths).select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("digest"))


def pinned(spark: SparkSession, path: str, digest: str) -> DataFrame:
    """JSON lines of a file whose digest must be the given one."""
    got = digests(spark, [path]).first().digest
    if got != digest:
        raise ValueError(f"{path}: digest {got} instead of {digest}")
    return spark.read.json(path)


def positions(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """rows with their place from 0 in the order, by ranges: no task sees more than its range.

    The ranges are written down before they are counted, so a lost executor cannot deal them anew; a row for each range reaches the driver.
    """
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = cut(ranged.withColumns({f"{name}_part": F.spark_partition_id(), f"{name}_row": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))}))
    counts = sorted((r[0], r[1]) for r in placed.groupBy(f"{name}_part").count().collect())
    before, starts = 0, []
    for part, n in counts:
        starts.append((part, before))
        before += n
    base = rows.sparkSession.createDataFrame(starts, f"{name}_part int, {name}_base long")
    return placed.join(F.broadcast(base), f"{name}_part").withColumn(name, F.col(f"{name}_base") + F.col(f"{name}_row")).drop(f"{name}_part", f"{name}_row", f"{name}_base")


def seeded_sample(rows: DataFrame, order: list[str], n: int | None, seed: int) -> DataFrame:
    """n rows in their order, drawn as CPython's generator draws positions; None or too many keeps all.

    Only the n drawn positions are sent out, so n is bounded by what the caller samples.
    """
    total = rows.count()
    if n is None or n >= total:
        return rows
    drawn = sorted(random.Random(seed).sample(range(total), n))
    picked = rows.sparkSession.createDataFrame([(k,) for k in drawn], "drawn_at long")
    return positions(rows, order, "drawn_at").join(F.broadcast(picked), "drawn_at").drop("drawn_at")


def stride_sample(rows: DataFrame, order: list[str], stride: int, most: int | None = None) -> DataFrame:
    """Every stride-th row in the order, from the first, at most ``most`` of them."""
    at = positions(rows, order, "stride_at")
    kept = at.filter(F.col("stride_at") % stride == 0)
    return (kept if most is None else kept.filter(F.col("stride_at") < stride * most)).drop("stride_at")


def source_block(title: str, issue: int, date: str, url: str, digest: str) -> Column:
    """What an artifact says of the document it comes from."""
    return F.create_map(*[F.lit(str(x)) for kv in (("title", title), ("issue", issue), ("date", date), ("url", url), ("digest", digest)) for x in kv])


def write_artifacts(spark: SparkSession, path: str, version: int, source: Column, **tables: DataFrame) -> DataFrame:
    """One JSON document for each table, all made before the first is written, and their manifest: name, bytes, digest.

    A document holds the rows of its table in order as one text, so artifacts are of a size that one machine holds.
    """
    docs = {}
    for name, rows in tables.items():
        listed = F.to_json(F.array_sort(F.collect_list(F.struct(*rows.columns))), {"ignoreNullFields": "false"})
        head = F.concat(F.lit(f'{{"schema_version":{version},"source":'), F.to_json(source), F.lit(f',"{name}":'))
        docs[name] = rows.agg(listed.alias("rows")).select(F.concat(head, F.coalesce("rows", F.lit("[]")), F.lit("}")).alias("value")).first()[0]
    made = spark.createDataFrame(sorted(docs.items()), "name string, value string")
    manifest = made.select("name", F.octet_length("value").cast("long").alias("bytes"), F.sha2("value", 256).alias("digest"))
    for name, value in docs.items():
        spark.createDataFrame([(value,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/{name}")
    write_manifest(spark, {"schema_version": version, "artifacts": [r.asDict() for r in manifest.collect()]}, f"{path}/manifest", "overwrite")
    return manifest


def built_tasks(upstream: dict[str, DataFrame], seed: int, most: int, license_of: dict[str, str]) -> DataFrame:
    """Tasks of upstream sets: ``grade`` (question, answer behind ####), ``plain`` (problem, answer: plain numbers only),
    ``open`` (question, answer list: one undated answer). Each set is sampled by its seed."""
    out = []
    for name, rows in upstream.items():
        if name == "open":
            kept = rows.filter(undated_single(F.col("answer"), F.col("question")))
            text, gold, kind = F.col("question"), F.to_json(F.struct(F.get("answer", 0).alias("a"))), "qa"
            gold = F.regexp_extract(gold, r'^\{"a":(.*)\}$', 1)
        else:
            number = gold_number(F.col("answer")) if name == "grade" else F.when(F.col("answer").rlike(PLAIN_NUMBER), F.replace("answer", F.lit(","), F.lit("")).try_cast("double"))
            kept, text, kind = rows.filter(number.isNotNull()), F.col("question" if name == "grade" else "problem"), "math"
            gold = F.when(number == F.floor(number), number.cast("long").cast("string")).otherwise(number.cast("string"))
        drawn = seeded_sample(kept, ["row"], most, seed)
        out.append(drawn.select(F.format_string(f"{name}-%04d", "row").alias("id"), F.lit(kind).alias("kind"), F.trim(text).alias("prompt"), gold.alias("answer_json"), F.lit(name).alias("source"), F.lit(license_of[name]).alias("license")))
    every = out[0]
    for d in out[1:]:
        every = every.unionByName(d)
    return every


def stamp(at: datetime.datetime | None = None) -> str:
    return (at or datetime.datetime.now(datetime.UTC)).strftime("%Y%m%dT%H%M%SZ")


def mock_answers(prompts: DataFrame) -> DataFrame:
    """Canned texts by what the prompt holds: the deterministic stand-in of a model."""
    p = F.lower("prompt")
    return prompts.withColumn("text", F.when(F.contains(p, F.lit("rewrite")), "The pump is on. Stop it.").when(F.contains(p, F.lit("answer:")), "Work.\nAnswer: 4").otherwise("I cannot do this."))
