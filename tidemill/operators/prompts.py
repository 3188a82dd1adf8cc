"""Messages of a generation: the plain task, or with an instruction to write in the controlled language."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


INSTRUCTION = (
    "Write your answer in the controlled language. Keep sentences short and give each word one meaning.",
    "Allowed besides the vocabulary: numbers and these terms: ",
    "Vocabulary: ",
)
REWRITE = "Put the following text into the controlled language. Its facts, its numbers and its last answer line stay as they are.\n\n"
NO_TERMS = "none"


def instruction(terms: Column, words: Column | None = None) -> Column:
    """The system text: with the word list, or without where it is None."""
    listed = F.when(F.size(F.coalesce(terms, F.array().cast("array<string>"))) > 0, F.array_join(terms, ", ")).otherwise(NO_TERMS)
    lines = [F.lit(INSTRUCTION[0]), F.concat(F.lit(INSTRUCTION[1]), listed)] + ([F.concat(F.lit(INSTRUCTION[2]), words)] if words is not None else [])
    return F.concat_ws("\n", *lines)


def message(role: str, content: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), content.alias("content"))


def messages(arm: Column, prompt: Column, terms: Column, words: Column | None = None, draft: Column | None = None) -> Column:
    """A0: the prompt alone. A1: instruction and prompt. A2: instruction and the request to rewrite its draft, without
    which a row of A2 is an error."""
    plain = F.array(message("user", prompt))
    told = F.array(message("system", instruction(terms, words)), message("user", prompt))
    missing = F.raise_error(F.lit("a row of A2 has no draft")).cast("string")
    again = F.array(message("system", instruction(terms, words)), message("user", F.concat(F.lit(REWRITE), missing if draft is None else F.coalesce(draft, missing))))
    return F.when(arm == "A0", plain).when(arm == "A1", told).when(arm == "A2", again)


def assembled(tasks: DataFrame, word_list: DataFrame | None = None) -> DataFrame:
    """tasks (arm, prompt, technical_terms, perhaps draft) with their messages; word_list (ids): one row."""
    if word_list is not None:
        tasks = tasks.join(F.broadcast(word_list.select("ids").limit(1)), F.lit(True))
    words = F.col("ids") if word_list is not None else None
    out = tasks.withColumn("messages", messages(F.col("arm"), F.col("prompt"), F.col("technical_terms"), words, F.col("draft") if "draft" in tasks.columns else None))
    return out.drop("ids") if word_list is not None else out
