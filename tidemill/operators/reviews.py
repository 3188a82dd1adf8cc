"""Validation of a checker: its reports on dictionary examples, entry by entry, and the tables drawn from them.

A run is one report: run_id, side (ste, nonste, probe), key, word, pos, scored, targets, text, seconds, items
(group, kind, token, headword, origin).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemill.functions import exact
from tidemill.functions.text import WORD, sentence_case, stems, words_of
from tidemill.operators.compliance import hit, items, origins
from tidemill.operators.lexicon import targets


def entry_key() -> Column:
    """word (pos) [qualifier], as it is shown."""
    return F.concat(F.col("word"), F.lit(" ("), F.coalesce("pos", F.lit("None")), F.lit(")"), F.when(F.coalesce("qualifier", F.lit("")) != "", F.concat(F.lit(" ["), "qualifier", F.lit("]"))).otherwise(""))


def parsed(entries: DataFrame) -> DataFrame:
    """Entries with an example (word, pos, qualifier, forms, approved, ste_example, nonste_example) -> also key,
    targets and meaning_only: not approved, but the same word and part of speech is."""
    yes = entries.filter("approved").select(F.lower("word").alias("k_word"), F.col("pos").alias("k_pos")).distinct().withColumn("both", F.lit(True))
    same = (F.lower("word") == F.col("k_word")) & F.col("pos").eqNullSafe(F.col("k_pos"))
    out = entries.filter("coalesce(ste_example, '') <> ''").join(yes, same, "left").withColumn("meaning_only", ~F.col("approved") & F.coalesce("both", F.lit(False)))
    return out.drop("k_word", "k_pos", "both").withColumns({"key": entry_key(), "targets": targets(F.col("word"), F.col("forms"), F.col("qualifier"))})


def jobs(entries: DataFrame, probes: DataFrame) -> DataFrame:
    """One job for each text to check: the examples of each entry, and of the probes (key) the first in sentence case."""
    base = entries.select("key", "word", "pos", "targets", (~F.col("approved") & ~F.col("meaning_only")).alias("scored"), "ste_example", "nonste_example")
    side = lambda d, name, text: d.select(F.lit(name).alias("side"), "key", "word", "pos", "targets", "scored", text.alias("text"))
    out = side(base, "ste", F.col("ste_example")).unionByName(side(base.filter("coalesce(nonste_example, '') <> ''"), "nonste", F.col("nonste_example")))
    out = out.unionByName(side(base.join(probes.select("key").distinct(), "key", "left_semi"), "probe", sentence_case(F.col("ste_example"))))
    return out.withColumn("run_id", F.concat_ws("/", "side", "key"))


def runs(job: DataFrame, reports: DataFrame, senses: DataFrame) -> DataFrame:
    """Jobs with their reports (run_id, seconds, findings, signals) by run_id; a job without its report is an error."""
    flat = items(reports.select(F.col("run_id").alias("id"), "findings", "signals"), senses)
    each = flat.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("place", "group", "kind", "token", "headword", "origin"))).alias("found"))
    each = each.select(F.col("id").alias("run_id"), F.transform("found", lambda i: F.struct(i["group"].alias("group"), i["kind"].alias("kind"), i["token"].alias("token"), i["headword"].alias("headword"), i["origin"].alias("origin"))).alias("items"))
    kind = "array<struct<group:string,kind:string,token:string,headword:string,origin:string>>"
    both = job.join(reports.select("run_id", "seconds"), "run_id", "left").join(each, "run_id", "left")
    sure = F.when(F.col("seconds").isNull(), F.raise_error(F.concat(F.lit("no report of "), "run_id"))).otherwise(F.col("seconds"))
    return both.withColumns({"seconds": sure, "items": F.coalesce(F.col("items").cast(kind), F.array().cast(kind))})


def kind_label(item: Column) -> Column:
    return F.when(item["kind"] == "not_approved", F.concat(F.lit("not_approved ("), item["origin"], F.lit(")"))).otherwise(item["kind"])


def blamed(item: Column) -> Column:
    """A finding that is the checker's own: of another kind, or on a word of the dictionary."""
    return (item["group"] == "finding") & ((item["kind"] != "not_approved") | (item["origin"] == "dictionary"))


def any_of(test) -> Column:
    return F.exists("items", test)


def false_positives(run: DataFrame) -> DataFrame:
    """One row: examples, those with any finding, with a homograph, with a finding that is the checker's own."""
    return run.filter("side = 'ste'").agg(
        F.count("*").alias("examples"), F.count_if(any_of(lambda i: i["group"] == "finding")).alias("any_finding"),
        F.count_if(any_of(lambda i: i["origin"] == "homograph")).alias("homograph"), F.count_if(any_of(blamed)).alias("checker_owned"),
    )


def kinds(run: DataFrame) -> DataFrame:
    """group, kind -> items and examples with one or more, of the first side."""
    each = run.filter("side = 'ste'").select("run_id", F.explode("items").alias("i")).select("run_id", F.col("i.group").alias("group"), kind_label(F.col("i")).alias("kind"))
    return each.groupBy("group", "kind").agg(F.count("*").alias("items"), F.countDistinct("run_id").alias("examples"))


def by_kind(run: DataFrame) -> DataFrame:
    """kind -> examples of either side that have it."""
    each = run.filter("side <> 'probe'").select("run_id", "side", F.explode(F.array_distinct(F.transform("items", kind_label))).alias("kind"))
    return each.groupBy("kind").agg(F.count_if(F.col("side") == "ste").alias("ste"), F.count_if(F.col("side") == "nonste").alias("nonste"))


def hits(run: DataFrame) -> DataFrame:
    """The scored runs of the second side with how they name their headword."""
    return run.filter("side = 'nonste' AND scored").withColumn("hit", hit(F.col("items"), F.col("targets"), F.col("word")))


def by_pos(run: DataFrame) -> DataFrame:
    """pos -> examples, those with a finding of the checker's own, scored runs and their hits."""
    pos = F.coalesce("pos", F.lit("None")).alias("pos")
    ste = run.filter("side = 'ste'").groupBy(pos).agg(F.count("*").alias("examples"), F.count_if(any_of(blamed)).alias("owned"))
    told = ("finding", "inflected", "signal", "miss")
    non = hits(run).groupBy(pos).agg(F.count("*").alias("scored"), *[F.count_if(F.col("hit") == h).alias(h) for h in told])
    return ste.join(non, "pos", "left").fillna(0, ["scored", *told])


def attested(run: DataFrame, least: int = 2) -> DataFrame:
    """token of the homographs that the findings of two or more first-side examples name."""
    each = run.filter("side = 'ste'").select("run_id", F.explode(F.array_distinct(F.transform(F.filter("items", lambda i: i["origin"] == "homograph"), lambda i: i["token"]))).alias("token"))
    return each.groupBy("token").agg(F.count("*").alias("n")).filter(F.col("n") >= least).select("token")


def document_frequency(texts: DataFrame, words: Column, least: int = 2) -> DataFrame:
    """word, n of the words (an array column of texts) that two or more texts have."""
    each = texts.select(F.explode(F.array_distinct(words)).alias("word"))
    return each.groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= least)


def allow_list(texts: DataFrame, senses: DataFrame, headwords: DataFrame, least: int = 2) -> DataFrame:
    """word of those in two or more texts (id, text) that no sense (token) knows and that are no -s or -ed form of a
    headword (word, lower case)."""
    often = document_frequency(texts, words_of(F.upper("text")), least)
    unknown = often.join(senses.select(F.col("token").alias("s_token")).distinct(), F.lower("word") == F.col("s_token"), "left_anti")
    formed = unknown.select("word", F.explode(stems(F.col("word"), ing=False)).alias("base")).join(headwords.select(F.col("word").alias("base")).distinct(), "base", "left_semi")
    return unknown.select("word").join(formed.select("word").distinct(), "word", "left_anti")


def misses(run: DataFrame) -> DataFrame:
    """key, flagged, text of the scored runs that name their headword nowhere; flagged: the tokens they name instead."""
    named = F.transform(F.filter("items", lambda i: (i["group"] == "finding") & (i["token"] != "")), lambda i: i["token"])
    return hits(run).filter("hit = 'miss'").select("key", F.array_sort(F.array_distinct(named)).alias("flagged"), "text")


def worst(run: DataFrame, most: int = 20) -> DataFrame:
    """key, n of the first-side runs with the most findings of the checker's own; ties by key."""
    n = F.size(F.filter("items", blamed))
    return run.filter("side = 'ste'").select("key", n.alias("n"), "text").filter("n > 0").orderBy(F.desc("n"), "key").limit(most)


def probe_gaps(run: DataFrame) -> DataFrame:
    """key, only_in, group, kind, token, n: items that the probe has more or less often than the first side."""
    each = run.filter("side <> 'nonste'").join(run.filter("side = 'probe'").select("key"), "key", "left_semi").select("key", "side", F.explode("items").alias("i"))
    count = each.groupBy("key", F.col("i.group").alias("group"), F.col("i.kind").alias("kind"), F.col("i.token").alias("token")).agg((F.count_if(F.col("side") == "ste") - F.count_if(F.col("side") == "probe")).alias("gap"))
    return count.filter("gap <> 0").select("key", F.when(F.col("gap") > 0, "capitals").otherwise("sentence case").alias("only_in"), "group", "kind", "token", F.abs("gap").alias("n"))


def fresh_tokens(reports: DataFrame, senses: DataFrame) -> DataFrame:
    """token of the reports (findings, signals) that no lookup has seen and whose words are words."""
    named = F.array_compact(F.concat(F.transform("findings", lambda f: f["token"]), F.transform("signals", lambda f: f["token"])))
    seen = reports.select(F.explode(named).alias("t")).select(F.lower("t").alias("token")).filter("token <> ''").distinct()
    fresh = seen.join(senses.select("token").distinct(), "token", "left_anti")
    return fresh.filter(F.forall(F.split("token", r"\s+"), lambda w: w.rlike(f"^(?:{WORD})$")))


def timing(run: DataFrame, *by: str) -> DataFrame:
    """Runs, mean and longest seconds, of each group or of all; the mean does not depend on the order of the rows."""
    runs = run.groupBy(*by).agg(F.count("*").alias("runs"), F.max("seconds").alias("most"))
    means = exact.moments(run, [*by], {"seconds": F.col("seconds")}).withColumnRenamed("seconds_mean", "mean")
    if not by:
        return runs.join(means.select("mean"), how="left").select("runs", "mean", "most")  # a row on each side
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"m_{c}")) for c in by])
    return runs.join(means.select(*[F.col(c).alias(f"m_{c}") for c in by], "mean"), same).select(*by, "runs", "mean", "most")


def gate_table(gates: DataFrame, *names: str) -> DataFrame:
    """gate, rejects, percent from a row for each example with its number of findings under each gate: an example with
    any is rejected."""
    each = gates.select(F.explode(F.array(*[F.struct(F.lit(c).alias("gate"), F.col(c).alias("n")) for c in names])).alias("g")).select("g.*")
    rejects = F.count_if(F.col("n") > 0)
    return each.groupBy("gate").agg(rejects.alias("rejects"), (100.0 * rejects / F.count("*")).alias("percent"))


def recall(told: DataFrame) -> DataFrame:
    """hit -> n and share of all; at most four rows reach the window."""
    counted = told.groupBy("hit").agg(F.count("*").alias("n"))
    return counted.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy()))


def ranked(counted: DataFrame, most: int, *first_seen: str) -> DataFrame:
    """The most frequent rows (n), ties by where they were first seen."""
    return counted.orderBy(F.desc("n"), *first_seen).limit(most)


__all__ = ["allow_list", "any_of", "attested", "blamed", "by_kind", "by_pos", "document_frequency", "entry_key", "false_positives", "fresh_tokens", "gate_table", "hits", "jobs", "kind_label", "kinds", "misses", "origins", "parsed", "probe_gaps", "ranked", "recall", "runs", "timing", "worst"]
