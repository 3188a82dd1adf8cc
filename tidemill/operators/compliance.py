"""Vocabulary compliance: greedy longest phrase match, the naive rate, the gate, report items."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.functions.text import plural, stems, term_phrases, tokens
from tidemill.operators.matcher import Batch, Phrases, parts

#: Largest lexicon that is sent to every executor; a dictionary has some thousand phrases.
MAX_PHRASES = 1_000_000


def approved_phrases(approved: DataFrame) -> DataFrame:
    """Every form and plural of the approved words, uppercase; phrases with an ellipsis are left out."""
    every = F.concat(F.array("word"), F.coalesce("forms", F.array().cast("array<string>")), F.array("plural"))
    return approved.select(F.explode(F.array_compact(every)).alias("p")).select(F.upper("p").alias("phrase")).filter("NOT contains(phrase, '...')").distinct()


def lexicon_of(phrases: DataFrame) -> frozenset[str]:
    """The phrases on the driver; a lexicon beyond MAX_PHRASES is an error, not a broadcast."""
    rows = phrases.select("phrase").limit(MAX_PHRASES + 1).collect()
    if len(rows) > MAX_PHRASES:
        raise ValueError(f"a lexicon has at most {MAX_PHRASES} phrases")
    return frozenset(" ".join(r.phrase.split()) for r in rows)


def longest_match(toks: list[str], phrases: frozenset[str], longest: int) -> tuple[list[str], list[str]]:
    """From left to right the longest phrase that starts here, else one token that does not conform: what a match is, for one list."""
    good, bad, i, n = [], [], 0, len(toks)
    while i < n:
        for k in range(min(longest, n - i), 0, -1):
            if (p := " ".join(toks[i : i + k])) in phrases:
                good.append(p)
                i += k
                break
        else:
            bad.append(toks[i])
            i += 1
    return good, bad


def match(spark: SparkSession, phrases: frozenset[str]):
    """Column function: tokens -> struct (conforming phrases, nonconforming tokens), as ``longest_match`` gives them."""
    shared = spark.sparkContext.broadcast(Phrases(phrases))

    @F.arrow_udf("struct<conforming: array<string>, nonconforming: array<string>>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for lists in batches:
            yield pa.concat_arrays([matched(lists.slice(at, n)) for at, n in parts(lists)])

    def matched(lists: pa.Array) -> pa.Array:
        b = Batch(lists)
        stops, size = b.match(shared.value)
        found = [b.lists(b.texts(stops[of], size[of]), b.row[stops[of]]) for of in (size > 0, size == 0)]
        return pa.StructArray.from_arrays(found, ["conforming", "nonconforming"])

    return run


def naive(spark: SparkSession, phrases: frozenset[str]):
    """Column function: (text, terms) -> struct (rate, words).

    Digit tokens go, then the declared terms by longest match; the rest, joined anew, is matched
    against the lexicon. The rate is null where nothing is left. Rows that declare the same terms are matched together.
    """
    shared = spark.sparkContext.broadcast(Phrases(phrases))

    @F.arrow_udf("struct<rate: double, words: array<string>>")
    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        compiled = lru_cache(maxsize=4096)(Phrases)
        for lists, terms in batches:
            yield pa.concat_arrays([rated(lists.slice(at, n), terms.slice(at, n), compiled) for at, n in parts(lists)])

    def rated(lists: pa.Array, terms: pa.Array, compiled: Callable[[tuple[str, ...]], Phrases]) -> pa.Array:
        b = Batch(lists)
        b = b.kept(~np.array([w.isdigit() for w in b.words], bool)[b.codes])
        declared: dict[tuple[str, ...], int] = {}
        kind = np.array([declared.setdefault(tuple(t or ()), len(declared)) for t in terms.to_pylist()], np.int64)
        rest = np.zeros(len(b.codes), bool)
        for own, k in declared.items():
            of = np.flatnonzero(kind[b.row] == k)
            stops, size = b.kept(of).match(compiled(own))
            rest[of[stops[size == 0]]] = True
        b = b.kept(rest)
        stops, size = b.match(shared.value)
        row = b.row[stops]
        good, every = np.bincount(row, size, minlength=b.n), np.bincount(row, np.maximum(size, 1), minlength=b.n)
        rate = pa.array(np.divide(good, every, out=np.zeros(b.n), where=every > 0), mask=every == 0)
        order = np.argsort(np.array(b.words, object)) if b.words else np.zeros(0, np.int64)
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        odd = np.unique(row[size == 0] * max(1, len(order)) + rank[b.codes[stops[size == 0]]])
        words = pa.array(b.words, pa.string()).take(pa.array(order[odd % max(1, len(order))]))
        return pa.StructArray.from_arrays([rate, b.lists(words, odd // max(1, len(order)))], ["rate", "words"])

    return lambda text, terms: run(tokens(text), term_phrases(terms))


def gate_keeps(finding: Column, known: Column, h: Column) -> Column:
    """The finding still rejects: never an -ing form, always another kind; a word outside the dictionary
    unless it is attested (h), where it has a headword or is known."""
    token, head = F.lower(F.coalesce(finding["token"], F.lit(""))), F.coalesce(finding["headword"], F.lit(""))
    return (
        F.when(finding["kind"] == "ing_form", False)
        .when(finding["kind"] != "not_approved", True)
        .when(F.array_contains(h, token), False)
        .otherwise((head != "") | F.array_contains(known, token))
    )


def checked(report: DataFrame, known: Column | None = None, h: Column | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """Reports (id, ok, findings) -> counts by kind, words that are not approved, and the gate's verdict;
    columns named in ``keep`` go along."""
    kinds = F.array_sort(F.array_distinct(F.transform("findings", lambda f: f["kind"])))
    count = lambda k: F.struct(k, F.size(F.filter("findings", lambda f: f["kind"] == k)))
    kept = F.size(F.filter("findings", lambda f: gate_keeps(f, known, h))) if known is not None else F.lit(None).cast("int")
    return report.select(
        "id", "ok", F.size("findings").alias("n_findings"), F.map_from_entries(F.transform(kinds, count)).alias("by_kind"),
        F.transform(F.filter("findings", lambda f: f["kind"] == "not_approved"), lambda f: f["token"]).alias("words"),
        (kept == 0).alias("gate_ok"), kept.alias("gate_findings"), *keep,
    )


def findings_by_kind(findings: DataFrame) -> DataFrame:
    """Findings (id, kind) -> kind, n_items, and n_examples that have one or more."""
    return findings.groupBy("kind").agg(F.count("*").alias("n_items"), F.countDistinct("id").alias("n_examples"))


def items(report: DataFrame, senses: DataFrame) -> DataFrame:
    """Reports (id, findings, signals) -> one row for each finding, then each signal; origin only of words that
    are not approved.

    senses: token, approved, names_term, noun. Unknown without a sense; dictionary with an approved
    one; homograph where one names the word as a term, or none is a noun; else dictionary.
    """

    def named(column: str, group: str) -> Column:
        fields = {f.name for f in report.schema[column].dataType.elementType.fields}
        get = lambda x, f: x[f] if f in fields else F.lit(None).cast("string")
        one = lambda x: F.struct(F.lit(group).alias("group"), x["kind"].alias("kind"), F.lower(F.coalesce(get(x, "token"), get(x, "mark"), F.lit(""))).alias("token"), F.lower(F.coalesce(get(x, "headword"), F.lit(""))).alias("headword"))
        return F.transform(F.coalesce(column, F.array()), one)

    every = F.concat(named("findings", "finding"), *([named("signals", "signal")] if "signals" in report.columns else []))
    flat = report.select("id", F.posexplode(every).alias("place", "i")).select("id", "place", "i.*")
    return flat.join(origins(senses), "token", "left").withColumn("origin", F.when(F.col("kind") == "not_approved", F.coalesce("origin", F.lit("unknown"))).otherwise(""))


def origins(senses: DataFrame) -> DataFrame:
    per = senses.groupBy("token").agg(F.bool_or("approved").alias("a"), F.bool_or("names_term").alias("t"), F.bool_or("noun").alias("n"))
    return per.select("token", F.when(F.col("a"), "dictionary").when(F.col("t") | ~F.col("n"), "homograph").otherwise("dictionary").alias("origin"))


def hit(items: Column, targets: Column, headword: Column) -> Column:
    """How a report names a headword: finding, inflected, signal or miss, the best of them."""
    first = F.split(F.lower(headword), " ")[0]
    stem = F.substring(first, F.lit(1), F.greatest(F.lit(3), F.length(first) - 2))
    bad = lambda i: i["kind"] == "not_approved"
    finding = lambda i: i["group"] == "finding"
    named = F.exists(items, lambda i: finding(i) & bad(i) & (F.array_contains(targets, i["token"]) | F.array_contains(targets, i["headword"])))
    inflected = F.exists(items, lambda i: finding(i) & (bad(i) | (i["kind"] == "ing_form")) & F.startswith(i["token"], stem))
    signal = F.exists(items, lambda i: ~finding(i) & F.arrays_overlap(stems(i["token"]), targets))
    return F.when(named, "finding").when(inflected, "inflected").when(signal, "signal").otherwise("miss")


def dictionary_words(approved: DataFrame, unapproved: DataFrame) -> DataFrame:
    """Distinct lowercase spellings: words and forms, and plurals of approved words."""
    cols = lambda d, more: d.select(F.explode(F.array_compact(F.concat(F.array("word"), "forms", more))).alias("w"))
    both = cols(approved, F.array("plural")).union(cols(unapproved, F.array().cast("array<string>")))
    return both.select(F.lower("w").alias("word")).distinct()


def with_plural(nouns: DataFrame) -> DataFrame:
    return nouns.withColumn("plural", F.when(F.col("pos") == "n", plural(F.col("word"))))
