"""Generations of the arms: one call for A0 and A1, a draft and its rewrite for A2."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.operators import prompts, scoring
from tidemill.operators.scan import cut

#: Columns that an answer may lack, and what they are then.
LACKING = {"think_open": False, "truncated": False, "latency_s": 0.0}
#: Columns of a generation that has a draft before it.
DRAFT = {"draft": "string", "draft_correct": "boolean", "draft_truncated": "boolean", "draft_reasoning_tokens": "int", "draft_generated_tokens": "int", "draft_latency_s": "double"}


def asked(tasks: DataFrame, answer: Callable[[DataFrame], DataFrame], word_list: DataFrame | None = None, tokens: scoring.Tokens | None = None) -> DataFrame:
    """tasks with the back end's answer and its measures, by ids where the back end gives ``token_ids`` and there is a tokenizer. A model may answer anew each time it is asked, so the answers
    are kept before anything reads them. The back end sees the messages and, joined, the ``prompt``."""
    told = prompts.assembled(tasks.withColumn("task_prompt", F.col("prompt")), word_list)
    said = answer(told.withColumn("prompt", F.array_join(F.transform("messages", lambda m: m["content"]), "\n")))
    said = said.withColumns({c: F.lit(v) for c, v in LACKING.items() if c not in said.columns})
    return cut(scoring.measured(said, tokens if "token_ids" in said.columns else None).withColumn("prompt", F.col("task_prompt")).drop("task_prompt"))


def generated(tasks: DataFrame, answer: Callable[[DataFrame], DataFrame], word_list: DataFrame | None = None, tokens: scoring.Tokens | None = None) -> DataFrame:
    """tasks (arm, kind, prompt, technical_terms, gold_number, gold_text) -> measured generations with draft columns.

    The draft of A2 is what A0 is asked, and its final text is what A2 is asked to rewrite."""
    plain = tasks.withColumns({"arm_asked": F.col("arm"), "arm": F.when(F.col("arm") == "A2", "A0").otherwise(F.col("arm"))})
    once = asked(plain, answer, word_list, tokens).withColumn("arm", F.col("arm_asked")).drop("arm_asked")
    single = once.filter("arm <> 'A2'").withColumns({c: F.lit(None).cast(t) for c, t in DRAFT.items()})
    score = scoring.score(F.col("kind"), F.col("gold_number"), F.col("gold_text"), F.col("final"))
    of_draft = {"draft": F.col("final"), "draft_correct": score["correct"], "draft_truncated": F.col("truncated"), "draft_reasoning_tokens": F.col("reasoning_tokens"), "draft_generated_tokens": F.col("generated_tokens"), "draft_latency_s": F.col("latency_s")}
    drafts = once.filter("arm = 'A2'").select(*[F.col(f"`{c}`") for c in tasks.columns], *[v.cast(DRAFT[c]).alias(c) for c, v in of_draft.items()])
    return single.unionByName(asked(drafts, answer, word_list, tokens))


__all__ = ["asked", "generated"]
