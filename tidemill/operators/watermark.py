"""Green-list text watermarks: lists by previous token, detection, matched lengths.

The list of a previous token comes from a Mersenne Twister that Spark lacks, so a Python function builds it, once for
each distinct previous token, as a row of bits; detection joins pairs with these rows and reads a bit. Pairs are counted
first, so a frequent pair is one row, and a previous token has as many rows at most as the vocabulary has ids.
"""

from __future__ import annotations

import hashlib
import random
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemill.operators.scan import LARGE_KEY, Take, cut, free, ordered
from tidemill.operators.stats import z_statistic


class Scheme(NamedTuple("Scheme", [("vocab_size", int), ("gamma", float), ("key", int)])):
    """Which tokens are green: a share gamma of vocab_size ids, drawn anew behind each token by a key."""

    def __new__(cls, vocab_size: int, gamma: float = 0.25, key: int = 0) -> Scheme:
        needs = {"vocab_size must be a whole number from 1": type(vocab_size) is int and vocab_size > 0, "gamma must be between 0 and 1": 0 < gamma < 1}
        if wrong := [text for text, met in needs.items() if not met]:
            raise ValueError("; ".join(wrong))
        return super().__new__(cls, vocab_size, gamma, key)


def green_list(scheme: Scheme, previous: int) -> frozenset[int]:
    """Fixed scheme: SHA-256 of "key:previous" seeds CPython's generator, which samples the ids."""
    seed = hashlib.sha256(f"{scheme.key}:{previous}".encode()).digest()
    size = max(1, int(scheme.gamma * scheme.vocab_size))
    return frozenset(random.Random(seed).sample(range(scheme.vocab_size), size))


def pairs(sequences: DataFrame) -> DataFrame:
    """seq, tokens -> seq, prev, cur for each two neighbours."""
    n = F.size("tokens")
    two = F.transform(F.sequence(F.lit(0), n - 2), lambda i: F.struct(F.get("tokens", i).alias("prev"), F.get("tokens", i + 1).alias("cur")))
    return sequences.filter(n >= 2).select("seq", F.explode(two).alias("p")).select("seq", "p.prev", "p.cur")


def row_pairs(rows: DataFrame, *order: str, most: str | None = None, large: int = LARGE_KEY) -> DataFrame:
    """The same from a row for each token (seq, token), without an array of a sequence and without a task that holds a
    long one; with ``most``, a column of seq, only of the first so many tokens."""
    two = ordered(rows, ["seq"], [*order], large).take(cur=Take("lead", F.col("token")), place=Take("sum", F.lit(1))).result().filter("cur IS NOT NULL")
    return (two.filter(F.col("place") < F.col(most)) if most else two).select("seq", F.col("token").alias("prev"), "cur")


def green_words(scheme: Scheme, previous: int) -> np.ndarray:
    """The green list as bits, 64 to a word, the first id in the lowest bit."""
    bits = np.zeros(-(-scheme.vocab_size // 64) * 64, np.uint8)
    bits[list(green_list(scheme, previous))] = 1
    return np.packbits(bits, bitorder="little").view("<u8").view(np.int64)


def green_table(previous: DataFrame, scheme: Scheme) -> DataFrame:
    """prev, words: the list of each distinct prev, built once and kept, for every detection that follows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, len(b), 256):
                part = b.column(0).slice(at, 256)
                lists = pa.array([green_words(scheme, p) for p in part.to_pylist()], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([part, lists], ["prev", "words"])

    distinct = previous.select(F.col("prev").cast("long").alias("prev")).filter("prev IS NOT NULL").distinct()
    return cut(distinct.mapInArrow(run, "prev long, words array<bigint>"))


def is_green(words: Column, token: Column) -> Column:
    """Whether a token's bit is set; ids outside the vocabulary are not green."""
    word = F.when(token >= 0, F.get(words, F.floor(token / 64).cast("int")))
    return F.coalesce(F.getbit(word, F.pmod(token, F.lit(64)).cast("int")) == 1, F.lit(False))


def membership(distinct: DataFrame, scheme: Scheme, table: DataFrame | None = None) -> DataFrame:
    """prev, cur -> also green, by the lists of a table or, without one, of a table of the rows' own prevs."""
    chosen = distinct.select(F.col("prev").cast("long").alias("prev"), F.col("cur").cast("long").alias("cur")).distinct()
    lists = green_table(chosen, scheme) if table is None else table
    return chosen.join(lists, "prev").select("prev", "cur", is_green(F.col("words"), F.col("cur")).alias("green"))


def judged(found: DataFrame, every: DataFrame, scheme: Scheme, unique: bool = False, table: DataFrame | None = None) -> DataFrame:
    """Pairs (seq, prev, cur) -> z, greens, scored for each seq of every."""
    found = found.select("seq", F.col("prev").cast("long").alias("prev"), F.col("cur").cast("long").alias("cur"))
    counted = found.groupBy("seq", "prev", "cur").agg(F.lit(1).cast("long").alias("n") if unique else F.count("*").alias("n"))
    marked = counted.join(membership(found, scheme, table), ["prev", "cur"])
    sums = marked.groupBy("seq").agg(F.sum(F.when(F.col("green"), F.col("n")).otherwise(0)).alias("greens"), F.sum("n").alias("scored"))
    every = every.select("seq").distinct().join(sums, "seq", "left").fillna(0, ["greens", "scored"])
    return every.select("seq", z_statistic(F.col("greens"), F.col("scored"), scheme.gamma).alias("z"), "greens", "scored")


def detect(sequences: DataFrame, scheme: Scheme, unique: bool = False, table: DataFrame | None = None) -> DataFrame:
    """seq -> z, greens, scored. unique counts each distinct pair once; no pair gives zeros."""
    return judged(pairs(sequences), sequences, scheme, unique, table)


def detect_rows(rows: DataFrame, scheme: Scheme, *order: str, unique: bool = False, table: DataFrame | None = None) -> DataFrame:
    """``detect`` from a row for each token (seq, token)."""
    return judged(row_pairs(rows, *order), rows, scheme, unique, table)


def row_records(rows: DataFrame, scheme: Scheme, *order: str) -> DataFrame:
    """``watermark_records`` from a row for each token (task, arm, token): no array of a sequence is made."""
    rows = rows.withColumn("seq", F.struct("task", "arm"))
    table = green_table(rows.select(F.col("token").alias("prev")), scheme)
    sizes = rows.groupBy("seq").agg(F.count("*").alias("tokens")).withColumn("matched_len", F.min("tokens").over(Window.partitionBy("seq.task")))
    limits = sizes.select(F.col("seq").alias("l_seq"), "matched_len")
    full = detect_rows(rows, scheme, *order, table=table).select("seq", "greens", F.round("z", 3).alias("z_full"))
    short_rows = row_pairs(rows.join(limits, F.col("seq") == F.col("l_seq")).drop("l_seq"), *order, most="matched_len")
    short = judged(short_rows, rows, scheme, table=table).select("seq", F.round("z", 3).alias("z_matched"))
    return full.join(short, "seq").join(sizes, "seq").select("seq.task", "seq.arm", "tokens", "greens", "z_full", "matched_len", "z_matched")


def summary_lines(records: DataFrame) -> DataFrame:
    """One line for each watermark record."""
    return records.select(F.format_string("%s %s: full z %.3f, matched z %.3f", "task", "arm", "z_full", "z_matched").alias("line"))


def matched(sequences: DataFrame, by: str) -> DataFrame:
    """Sequences cut to the shortest of their group."""
    group, shortest = free(sequences, "group", "shortest")
    least = sequences.groupBy(F.col(by).alias(group)).agg(F.min(F.size("tokens")).alias(shortest))
    return sequences.join(least, F.col(by).eqNullSafe(F.col(group))).withColumn("tokens", F.slice("tokens", F.lit(1), F.col(shortest))).drop(group, shortest)


def watermark_records(sequences: DataFrame, scheme: Scheme) -> DataFrame:
    """task, arm, tokens -> z over the whole sequence and over the length that the task's arms share."""
    seqs = sequences.withColumn("seq", F.struct("task", "arm"))
    table = green_table(seqs.select(F.explode("tokens").alias("prev")), scheme)
    full = detect(seqs, scheme, table=table).withColumnsRenamed({"z": "z_full"})
    shared = matched(seqs, "task")
    short = detect(shared, scheme, table=table).select("seq", F.col("z").alias("z_matched")).join(shared.select("seq", F.size("tokens").alias("matched_len")), "seq")
    sizes = seqs.select("seq", F.size("tokens").alias("tokens"))
    return full.join(short, "seq").join(sizes, "seq").select("seq.task", "seq.arm", "tokens", "greens", F.round("z_full", 3).alias("z_full"), "matched_len", F.round("z_matched", 3).alias("z_matched"))


def biased(scores: Column, green: Column, delta: float) -> Column:
    """Scores with delta added at the green positions."""
    return F.transform(scores, lambda s, i: F.when(F.array_contains(green, i), s + F.lit(delta)).otherwise(s))
