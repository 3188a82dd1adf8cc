"""Dictionary entries to a lexicon, and the checks between them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemill.functions.text import plural


def built(entries: DataFrame) -> DataFrame:
    """word, pos, forms -> id, lowercase word, its distinct forms in order, and the plural of a noun."""
    word = F.lower("word")
    forms = F.array_distinct(F.concat(F.array(word), F.transform("forms", F.lower)))
    return entries.select(F.when(F.col("pos").isNull(), word).otherwise(F.concat(word, F.lit(" ("), "pos", F.lit(")"))).alias("id"), word.alias("word"), "pos", forms.alias("forms"), F.when(F.col("pos") == "n", plural(word)).alias("plural"))


def entry_lines(lines: DataFrame) -> DataFrame:
    """Lines of approved entries (entry, seq, text, is_reference, is_help): text before the first help line is
    the meaning, references after it are alternatives, the rest is help."""
    seen = F.max(F.col("is_help").cast("int")).over(Window.partitionBy("entry").orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    part = F.when(seen == 0, "meaning").when(F.col("is_reference") & ~F.col("is_help"), "alternative").otherwise("help")
    joined = lambda p: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("part") == p, F.struct("seq", "text")))), lambda x: x["text"]), " ").alias(p)
    return lines.withColumn("part", part).groupBy("entry").agg(*[joined(p) for p in ("meaning", "alternative", "help")])


def resolved(alternatives: DataFrame, approved: DataFrame) -> DataFrame:
    """alternatives (word, pos) with the approved entry they name: by word and pos (the last entry of a key),
    by form and pos, an adjective as a verb's participle, a phrase of approved words, or a word
    under any pos (the first entry). approved: seq, id, word, pos, forms."""
    key = approved.groupBy("word", "pos").agg(F.max_by("id", "seq").alias("by_key")).select(F.col("word").alias("k_w"), F.col("pos").alias("k_p"), "by_key")
    forms = approved.select("seq", "id", "pos", F.explode("forms").alias("form"))
    by_form = forms.groupBy("form", "pos").agg(F.min_by("id", "seq").alias("by_form")).select(F.col("form").alias("f_w"), F.col("pos").alias("f_p"), "by_form")
    verb = forms.filter("pos = 'v'").groupBy("form").agg(F.min_by("id", "seq").alias("by_verb")).withColumnRenamed("form", "v_w")
    first = approved.groupBy("word").agg(F.min_by("id", "seq").alias("by_any")).withColumnRenamed("word", "a_w")
    known = forms.select("form").union(approved.select("word")).distinct().withColumnRenamed("form", "p_w")
    # whether a word is a phrase of known words follows from the word alone
    parts = alternatives.filter("contains(word, ' ')").select(F.col("word").alias("h_w")).distinct().select("h_w", F.explode(F.split("h_w", " ")).alias("p_w"))
    phrase = parts.join(known.withColumn("ok", F.lit(True)), "p_w", "left").groupBy("h_w").agg(F.bool_and(F.coalesce("ok", F.lit(False))).alias("is_phrase"))
    out = (
        alternatives.join(key, (F.col("word") == F.col("k_w")) & F.col("pos").eqNullSafe(F.col("k_p")), "left")
        .join(by_form, (F.col("word") == F.col("f_w")) & F.col("pos").eqNullSafe(F.col("f_p")), "left")
        .join(verb, (F.col("word") == F.col("v_w")) & (F.col("pos") == "adj"), "left")
        .join(first, F.col("word") == F.col("a_w"), "left")
        .join(phrase, F.col("word") == F.col("h_w"), "left")
    )
    ref = F.coalesce("by_key", "by_form", "by_verb", F.when(F.coalesce("is_phrase", F.lit(False)), F.lit(None)).otherwise(F.col("by_any")))
    how = F.when(F.col("by_key").isNotNull(), "word").when(F.col("by_form").isNotNull(), "form").when(F.col("by_verb").isNotNull(), "participle").when(F.coalesce("is_phrase", F.lit(False)), "phrase").when(F.col("by_any").isNotNull(), "any").otherwise("unresolved")
    return out.select("word", "pos", ref.alias("ref"), how.alias("how"))


def dangling(refs: DataFrame, approved: DataFrame) -> DataFrame:
    return refs.join(approved.select(F.col("id").alias("ref")), "ref", "left_anti")


def absent(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Distinct keys of left that right lacks."""
    return left.select(key).distinct().join(right.select(key), key, "left_anti")


def multiset_gaps(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows that one side has more often than the other, as often as they exceed."""
    return left.exceptAll(right).withColumn("side", F.lit("left")).unionByName(right.exceptAll(left).withColumn("side", F.lit("right")))


def targets(word: Column, forms: Column, qualifier: Column) -> Column:
    """Lowercase headword, forms and qualifier, and each of their words."""
    every = F.filter(F.transform(F.concat(F.array(word), forms, F.array(qualifier)), F.lower), lambda x: x.isNotNull())
    return F.array_distinct(F.concat(every, F.flatten(F.transform(every, lambda x: F.split(x, " ")))))


def id_list(approved: DataFrame) -> DataFrame:
    return approved.agg(F.array_join(F.array_sort(F.collect_list(F.upper("id"))), ", ").alias("ids"))
