"""Answer scores and the arm record: text of one generation to its measures."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemill.functions.text import answer_line, contains_run, degenerate, n_space_words, normal_words, number_is, numbers, split_think, split_think_ids

ANSWER_LABEL = "Answer"


def score(kind: Column, gold_number: Column, gold_text: Column, text: Column) -> Column:
    """Struct (correct, fallback): the last answer line decides; without one the answer is wrong and
    fallback says whether the gold is in the text. Writing has neither."""
    line = answer_line(text)
    by_line = F.when(kind == "math", number_is(F.get(numbers(line), 0), gold_number)).when(kind == "qa", contains_run(normal_words(line), normal_words(gold_text)))
    anywhere = F.when(kind == "math", number_is(F.try_element_at(numbers(text), F.lit(-1)), gold_number)).when(kind == "qa", contains_run(normal_words(text), normal_words(gold_text)))
    scored = kind != "writing"
    return F.struct(
        F.when(scored & line.isNotNull(), by_line).when(scored, False).alias("correct"),
        F.when(scored & line.isNull(), anywhere).alias("fallback"),
    )


def allowed_terms(kind: Column, terms: Column) -> Column:
    return F.when(kind == "writing", terms).otherwise(F.array_append(terms, F.lit(ANSWER_LABEL)))


class Tokens(NamedTuple):
    """A tokenizer as columns: the ids of the think marks, ids to text, and text to its number of ids."""

    start: int
    end: int
    decode: Callable[[Column], Column]
    count: Callable[[Column], Column]


def measured(generations: DataFrame, tokens: Tokens | None = None) -> DataFrame:
    """text, think_open -> reasoning, final, their white-space word counts and the degenerate flag.

    With a tokenizer, rows that have ``token_ids`` are split and counted by them, and their final text is what the final ids
    decode to, as it is; a row without ids is split by its text, and its output is counted by the tokenizer too."""
    if tokens is not None:
        ids = F.col("token_ids").cast("array<bigint>")
        split = split_think_ids(ids, tokens.start, tokens.end, F.coalesce("think_open", F.lit(False)))
        own = measured(generations).withColumn("ids", split)
        own = own.withColumns({"reasoning": F.when(ids.isNotNull(), tokens.decode(F.col("ids.reasoning"))).otherwise(F.col("reasoning")), "final": F.when(ids.isNotNull(), tokens.decode(F.col("ids.final"))).otherwise(F.col("final"))})
        by_ids = lambda mine, other: F.when(ids.isNotNull(), mine).otherwise(F.col(other)).cast("int")
        counts = {"reasoning_tokens": by_ids(F.size("ids.reasoning"), "reasoning_tokens"), "generated_tokens": by_ids(F.size(ids), "generated_tokens")}
        return own.withColumns(counts | {"output_tokens": tokens.count(F.col("final")).cast("int"), "degenerate": degenerate(F.col("final"))}).drop("ids")
    d = generations.withColumn("parts", split_think(F.col("text"), F.coalesce("think_open", F.lit(False))))
    d = d.withColumns({"reasoning": F.trim("parts.reasoning"), "final": F.trim("parts.final")}).drop("parts")
    return d.withColumns({"reasoning_tokens": n_space_words(F.col("reasoning")), "output_tokens": n_space_words(F.col("final")), "degenerate": degenerate(F.col("final"))}).withColumn(
        "generated_tokens", F.col("reasoning_tokens") + F.col("output_tokens")
    )


def arm_records(measured_: DataFrame) -> DataFrame:
    """Measured generations with task columns -> records; arm A2 adds its draft's tokens and latency and, where the rows
    have a draft, says in ``rewrite`` what is the draft's and what the rewrite's."""
    a2 = F.col("arm") == "A2"
    plus = lambda c, d: F.when(a2, F.col(c) + F.coalesce(d, F.lit(0))).otherwise(F.col(c))
    s = score(F.col("kind"), F.col("gold_number"), F.col("gold_text"), F.col("final"))
    split = {"draft_text": "draft", "draft_correct": "draft_correct", "draft_generated_tokens": "draft_generated_tokens", "draft_reasoning_tokens": "draft_reasoning_tokens", "rewrite_generated_tokens": "generated_tokens", "rewrite_reasoning_tokens": "reasoning_tokens"}
    rewrite = [F.when(a2, F.struct(*[F.col(c).alias(n) for n, c in split.items()])).alias("rewrite")] if "draft" in measured_.columns else []
    return measured_.withColumn("s", s).select(
        "task_id", "kind", "arm", "sample", F.col("s.correct").alias("correct"), F.col("s.fallback").alias("fallback_correct"), "degenerate",
        (F.col("truncated") | (a2 & F.coalesce("draft_truncated", F.lit(False)))).alias("truncated"),
        plus("reasoning_tokens", F.col("draft_reasoning_tokens")).alias("reasoning_tokens"), plus("generated_tokens", F.col("draft_generated_tokens")).alias("generated_tokens"),
        F.col("final").alias("text"), "output_tokens", F.round(plus("latency_s", F.col("draft_latency_s")), 3).alias("latency_s"), F.round("compliance", 4).alias("compliance"), F.slice("nonconforming", 1, 50).alias("nonconforming"), *rewrite,
    )
