"""Commands: ``tasks`` validates task files, ``run`` makes a run of a back end's answers, ``watermark`` one of
watermarked token sequences, ``summarize`` prints the summary of a run, ``rescore`` checks its records afterwards with
a function of the user, ``validate`` compares a text with a lexicon, ``verify`` checks artifacts against each other,
``preflight`` says what keeps a GPU run from starting."""

from __future__ import annotations

import argparse
import datetime
import json
import pathlib
import re
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.functions import text as X
from tidemill.operators import compliance, generation, lexicon, report, rescoring, rules, scoring, stats, validation, verification, watermark
from tidemill.sources import checkers, environment, files
from tidemill.streaming import records as resumable

ARMS = ("A0", "A1", "A2")
#: What each preset of decoding sets.
PRESETS = {
    "thinking": {"temperature": 1.0, "top_p": 0.95, "top_k": 20, "max_new_tokens": 16384, "samples": 3},
    "greedy": {"temperature": 0.0, "top_p": 1.0, "top_k": 0, "max_new_tokens": 1024, "samples": 1},
}


def positive(text: str) -> int:
    n = int(text)
    if n < 1:
        raise argparse.ArgumentTypeError("an integer of 1 or more")
    return n


def tasks(spark: SparkSession, args: argparse.Namespace) -> int:
    by = ("kind", "source", "split")
    loaded = files.load_tasks(spark, task_files(spark, args), root=str(pathlib.Path.cwd()))
    for r in stats.task_counts(loaded, *by).orderBy(*by).collect():
        print(f"{r.kind} {r.source} {r.split}: {r.n}")
    return 0


def task_files(spark: SparkSession, args: argparse.Namespace) -> list[str]:
    """The files that were named, else the default ones."""
    return args.tasks or files.default_tasks(spark)


def decoding(args: argparse.Namespace) -> dict[str, float | int]:
    """The preset, with every flag that was given in its place."""
    return {k: v if getattr(args, k, None) is None else getattr(args, k) for k, v in PRESETS[args.decoding].items()}


def run(spark: SparkSession, args: argparse.Namespace) -> int:
    """Every task, sample and arm, task by task, then by sample, then by arm as given; part by part, so a run can be resumed."""
    paths, chosen = task_files(spark, args), decoding(args)
    drawn = files.seeded_sample(files.load_tasks(spark, paths), ["file_pos", "line_no"], args.limit, args.sample_seed)
    arms = F.posexplode(F.array(*map(F.lit, args.arms))).alias("arm_pos", "arm")
    each = drawn.withColumn("sample", F.explode(F.sequence(F.lit(0), F.lit(chosen["samples"] - 1)))).select("*", arms)
    words = approved = None
    if args.lexicon:
        approved, unapproved = files.read_lexicon(spark, args.lexicon)
        words = lexicon.id_list(approved) if args.word_list else None
    answer = checkers.backend(args.backend)
    phrases = None if approved is None else compliance.lexicon_of(compliance.approved_phrases(approved))
    order = ["file_pos", "line_no", "sample", "arm_pos"]

    def records(part: DataFrame) -> DataFrame:
        made = generation.generated(part.withColumns({"gold_number": F.col("answer_num"), "gold_text": F.col("answer_str")}), answer, words).withColumn("task_id", F.col("id"))
        terms = scoring.allowed_terms(F.col("kind"), F.coalesce("technical_terms", F.array().cast("array<string>")))
        if phrases is not None:
            made = made.withColumn("c", compliance.naive(spark, phrases)(F.col("final"), terms)).withColumns({"compliance": F.col("c.rate"), "nonconforming": F.col("c.words")})
        else:
            made = made.withColumns({"compliance": F.lit(None).cast("double"), "nonconforming": F.lit(None).cast("array<string>")})
        places = made.select(F.col("id").alias("task_id"), "arm", *order[:2], "sample", "arm_pos")
        rows = scoring.arm_records(made).withColumns({"model": F.lit(args.model), "backend": F.lit(args.backend)})
        if args.checker == "off":
            rows = rows.withColumn("checker", F.struct(F.lit("skipped").alias("status"), F.lit("off").alias("reason")))
        else:
            said = made.select(F.concat_ws("/", "id", "arm", F.col("sample").cast("string")).alias("id"), F.col("final").alias("text"), terms.alias("terms"))
            done = checkers.checker_column(checkers.outcomes(said, "id", checkers.named(args.checker), args.checker_calls))
            rows = rows.withColumn("key", F.concat_ws("/", "task_id", "arm", F.col("sample").cast("string"))).join(done.withColumnRenamed("id", "key"), "key").drop("key")
        placed = rows.join(places, ["task_id", "arm", "sample"])
        return placed.repartitionByRange(*order).sortWithinPartitions(*order).drop("file_pos", "line_no", "arm_pos")

    name = args.run_id or spark.range(1).select(report.run_id(F.lit(args.backend), F.lit(args.model), F.current_timestamp())).first()[0]
    out = f"{args.results}/{name}"
    if args.resume != checkers.exists(spark, f"{out}/work/_SUCCESS"):
        print(f"run: {out} is {'not begun' if args.resume else 'there already'}", file=sys.stderr)
        return 1
    if not args.resume:
        resumable.laid_out(each, order, -(-each.count() // args.part), out)
    resumable.resumed(spark, out, records)
    manifest = {"run_id": name, "mode": "arms", "model": args.model, "arms": args.arms, "decoding": chosen, "files": [r.asDict() for r in files.digests(spark, files.expand(spark, paths)).collect()], "environment": environment.facts()}
    files.write_manifest(spark, manifest, f"{out}/manifest", "overwrite")
    print(out)
    return 0


def watermark_(spark: SparkSession, args: argparse.Namespace) -> int:
    """z of token sequences (task, arm, pos, token) in JSON lines, in full and at the length that a task's arms share."""
    rows = spark.read.schema("task string, arm string, pos long, token long").json(args.tokens)
    records = watermark.row_records(rows, watermark.Scheme(args.vocab_size, args.gamma, args.wm_key), "pos")
    out = f"{args.results}/{args.run_id or 'watermark-' + files.stamp()}"
    records.write.mode("errorifexists").json(f"{out}/records")
    files.write_manifest(spark, {"mode": "watermark", "gamma": args.gamma, "key": args.wm_key, "vocab_size": args.vocab_size}, f"{out}/manifest")
    print(out)
    return 0


def validate(spark: SparkSession, args: argparse.Namespace) -> int:
    """The words of a text (or of a file, -f) that the lexicon does not approve."""
    said = "\n".join(r.value for r in spark.read.text(args.file, wholetext=True).collect()) if args.file else " ".join(args.text)
    phrases = compliance.lexicon_of(compliance.approved_phrases(files.read_lexicon(spark, args.lexicon)[0]))
    match = compliance.match(spark, phrases)
    r = spark.createDataFrame([(said,)], "text string").select(X.tokens(F.col("text")).alias("t")).select("t", match(F.col("t")).alias("m")).first()
    print(f"tokens {len(r.t)}, conforming phrases {len(r.m.conforming)}, other words {len(r.m.nonconforming)}")
    for w in sorted(set(r.m.nonconforming)):
        print(f"  {w}")
    return int(bool(r.m.nonconforming))


def verify(spark: SparkSession, args: argparse.Namespace) -> int:
    """Faults of a lexicon and of what stands beside it: dictionary entries, a rule table, the text and the verb list that both
    come from, and the artifacts' manifest. Each file that is named adds its checks; the notes are no faults."""
    approved, unapproved = files.read_lexicon(spark, args.lexicon)
    refs = unapproved.select(F.col("word").alias("from_word"), F.explode("alternatives").alias("a")).filter("a.ref IS NOT NULL").select("from_word", F.col("a.ref").alias("ref"))
    unresolved = unapproved.select("word", F.explode("alternatives").alias("a")).filter("a.unresolved IS NOT NULL").select("word", "a.unresolved")
    checks = {"dangling": lexicon.dangling(refs, approved), "unresolved": unresolved, "dead_end": verification.dead_ends(unapproved), "repeated": approved.groupBy("id").count().filter("count > 1")}
    text = spark.read.text(args.text, wholetext=True).agg(F.array_join(F.collect_list("value"), " ").alias("text")) if args.text else None
    if args.dictionary:
        entries = files.read_entries(spark, args.dictionary)
        checks |= {"entry": verification.entry_faults(entries), "case": validation.case_violations(entries).select("word"), "example": validation.example_faults(entries), "key": validation.repeated_keys(entries, "word", "pos", "qualifier")}
        if args.verbs:
            verbs = spark.read.text(args.verbs).select(F.trim("value").alias("word")).filter("word <> ''")
            checks["verbs"] = verification.set_gaps(verbs, entries.filter("pos = 'v' AND approved").select("word"))
        for r in verification.dictionary_counts(entries).collect():
            print(f"count entries: {r.entries}, keys: {r['keys']}, words: {r.words}")
    if args.rules:
        table = rules.rule_table(spark, args.rules)
        checks["rule"] = validation.repeated_keys(table, "id")
        if text is not None:
            checks["parameter"] = verification.parameter_faults(table.select("id", F.col("paraphrase").alias("statement"), "parameters"), text)
            listed = table.select(F.explode(F.from_json(F.get_json_object("parameters", "$.approved_ing"), "array<string>")).alias("id"))
            checks["ing"] = verification.ing_faults(listed, approved, text)
    if args.manifest:
        root = args.manifest.rpartition("/")[0] or "."
        listed = spark.read.option("multiLine", True).schema("artifacts array<struct<path: string, bytes: long, digest: string>>").json(args.manifest).select(F.inline("artifacts"))
        there = files.digests(spark, files.expand(spark, [f"{root}/*.json"])).withColumn("path", F.element_at(F.split("path", "/"), -1)).filter(F.col("path") != args.manifest.rpartition("/")[2])
        checks["artifact"] = validation.file_gaps(listed, there)
    faults = verification.report(**checks)
    for r in verification.notes(unapproved, approved).orderBy("note", "word", "detail").collect():
        print(f"note {r.note}: {r.word or ''} {r.detail}")
    found = faults.orderBy("check", "fault").collect()
    for r in found:
        print(f"fault {r.check}: {r.fault}")
    print(f"{len(found)} faults")
    return int(bool(found))


def latest(spark: SparkSession, run: str) -> DataFrame:
    """The records of a run as they were rescored, or as they were written."""
    there = checkers.exists(spark, f"{run}/rescored/_SUCCESS")
    return files.read_records(spark, f"{run}/rescored" if there else f"{run}/records")


def summarize(spark: SparkSession, args: argparse.Namespace) -> int:
    if files.read_manifest(spark, args.run)["mode"] == "watermark":
        lines = watermark.summary_lines(spark.read.schema(files.WATERMARK).json(f"{args.run}/records"))
        print("\n".join(r.line for r in lines.orderBy("line").toLocalIterator()))
        return 0
    arms = stats.spread(stats.per_sample(latest(spark, args.run)))
    print("\n".join(stats.summary_lines(arms, stats.tax(arms))))
    return 0


def rescore(spark: SparkSession, args: argparse.Namespace) -> int:
    """Check the records of a finished run whose check was skipped; the task files must be unchanged."""
    manifest = files.read_manifest(spark, args.run)
    if manifest["mode"] != "arms":
        print("rescore: runs of arms only", file=sys.stderr)
        return 1
    paths = [f["path"].removeprefix("file:") for f in manifest["files"]]
    then = spark.createDataFrame([(f["path"], f["digest"]) for f in manifest["files"]], "path string, digest string")
    gone = [p for p in paths if not checkers.exists(spark, p)]
    if gone or rescoring.changed_files(then, files.digests(spark, paths)).limit(1).count():
        print("rescore: a task file changed since the run", file=sys.stderr)
        return 1
    checker = checkers.named(args.checker)
    # always from the records as written, so that a second rescore gives the same
    rescoring.rescored(files.read_records(spark, f"{args.run}/records"), files.load_tasks(spark, paths), checker).write.mode("overwrite").option("ignoreNullFields", False).json(f"{args.run}/rescored")
    stamp = manifest | {"rescored": {"at": datetime.datetime.now(datetime.UTC).isoformat(), "checker": args.checker}}
    files.write_manifest(spark, stamp, f"{args.run}/rescored-manifest", "overwrite")
    return summarize(spark, args)


def preflight(_: None, args: argparse.Namespace) -> int:
    """The facts of this machine and what stops a run, also as a JSON file."""
    facts = environment.facts()
    found = environment.problems(facts, args.backend)
    host = re.sub(r"[^A-Za-z0-9.]+", "-", facts["host"]) or "host"
    out = pathlib.Path(args.out or f"{args.results}/preflight-{host}-{files.stamp()}.json")
    out.parent.mkdir(parents=True, exist_ok=True)
    out.write_text(json.dumps({"at": datetime.datetime.now(datetime.UTC).isoformat(), "backend": args.backend, "problems": found, "environment": facts}, indent=1))
    print("\n".join(found) or "ready")
    return int(bool(found))


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="python -m tidemill", description=__doc__)
    sub = top.add_subparsers(required=True)

    def add(f, *with_tasks: str) -> argparse.ArgumentParser:
        p = sub.add_parser(f.__name__.rstrip("_"), help=f.__doc__)
        p.set_defaults(func=f)
        if with_tasks:
            p.add_argument("--tasks", action="append", metavar="GLOB", help="default: tasks.jsonl, then tasks/*.jsonl")
        return p

    add(tasks, "tasks")
    r = add(run, "tasks")
    r.add_argument("--limit", type=positive)
    r.add_argument("--sample-seed", type=int, default=0)
    r.add_argument("--arms", nargs="+", choices=ARMS, default=["A0", "A2", "A1"])
    r.add_argument("--decoding", choices=sorted(PRESETS), default="greedy")
    r.add_argument("--samples", type=positive)
    r.add_argument("--temperature", type=float)
    r.add_argument("--top-p", type=float)
    r.add_argument("--top-k", type=int)
    r.add_argument("--max-new-tokens", type=positive)
    r.add_argument("--backend", default="mock", help="a registered back end or MODULE:FUNCTION")
    r.add_argument("--checker", default="off", help="off or MODULE:FUNCTION of (text, terms)")
    r.add_argument("--checker-calls", type=positive, help="calls under way in a task")
    r.add_argument("--part", type=positive, default=2000, help="generations that are made and kept at once")
    r.add_argument("--resume", action="store_true", help="go on with the run of --run-id where it ended")
    r.add_argument("--lexicon", metavar="FILE")
    r.add_argument("--word-list", action="store_true")
    r.add_argument("--model", default="mock")
    w = add(watermark_)
    w.add_argument("tokens")
    w.add_argument("--vocab-size", type=positive, required=True)
    w.add_argument("--gamma", type=float, default=0.25)
    w.add_argument("--wm-key", type=int, default=0)
    for p in (r, w):
        p.add_argument("--results", default="results")
        p.add_argument("--run-id")
    add(summarize).add_argument("run")
    again = add(rescore)
    again.add_argument("run")
    again.add_argument("--checker", required=True, metavar="MODULE:FUNCTION")
    v = add(validate)
    v.add_argument("text", nargs="*")
    v.add_argument("-f", "--file")
    c = add(verify)
    for p in (v, c):
        p.add_argument("--lexicon", required=True, metavar="FILE")
    for name in ("dictionary", "rules", "text", "verbs", "manifest"):
        c.add_argument(f"--{name}", metavar="FILE")
    f = add(preflight)
    f.add_argument("--backend", choices=["hf", "vllm"], default="vllm")
    f.add_argument("--results", default="results")
    f.add_argument("--out")
    return top


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    spark = None if args.func is preflight else SparkSession.builder.appName("tidemill").getOrCreate()
    try:
        return args.func(spark, args)
    except files.TaskError as e:
        print(f"task error:\n{e}", file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main())
