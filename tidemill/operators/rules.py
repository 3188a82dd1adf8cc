"""Writing rules with machine-readable limits, as checks on text columns.

They follow the limits of the rule table alone. No external grammar checker is here to compare them
with, so they are not validated against one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Limits in words and sentences, by kind of text.
MAX_WORDS = {"procedure": 20, "note": 25, "description": 25}
MAX_SENTENCES = 6
#: Approved words that end in -ing.
ING_APPROVED = ("lighting", "opening", "routing", "servicing", "mating", "missing", "remaining", "something", "during")
#: Borders of a word, spelled out: what \b means for letters beyond ASCII depends on the Java version.
LEFT, RIGHT = r"(?<![\p{L}\p{N}_])", r"(?![\p{L}\p{N}_])"
CONTRACTION = rf"(?i){LEFT}(?:[a-z]+(?:n['’]t|['’](?:re|ve|ll|d|m))|(?:it|that|there|he|she|what|let)['’]s){RIGHT}"


def sentences(text: Column) -> Column:
    """A list colon ends a sentence as well."""
    return F.filter(F.split(text, r"(?<=[.!?:])\s+"), lambda s: F.trim(s) != "")


def counted_words(sentence: Column) -> Column:
    """A parenthesis, a hyphenated word and a number with its unit are one word each."""
    one = F.regexp_replace(sentence, r"\([^()]*\)", " p ")
    one = F.regexp_replace(one, r"\b(\d+(?:\.\d+)?)\s+(mm|cm|m|km|g|kg|s|min|h|V|A|W|psi|bar)\b", "$1$2")
    return F.size(F.regexp_extract_all(one, F.lit(r"[\p{L}\p{N}][\p{L}\p{N}\p{M}.'’/-]*"), F.lit(0)))


def findings(text: Column, kind: str = "description", ing_allowed: Column | None = None) -> Column:
    """Struct of counts: long sentences, long paragraphs (of descriptions), semicolons, contractions, -ing words
    other than the approved ones."""
    allowed = F.array(*map(F.lit, ING_APPROVED)) if ing_allowed is None else ing_allowed
    ing = F.filter(F.regexp_extract_all(F.lower(text), F.lit(rf"{LEFT}[a-z]+ing{RIGHT}"), F.lit(0)), lambda w: ~F.array_contains(allowed, w))
    return F.struct(
        F.size(F.filter(sentences(text), lambda s: counted_words(s) > MAX_WORDS[kind])).alias("long_sentences"),
        (F.size(F.filter(F.split(text, r"\n\s*\n"), lambda p: F.size(sentences(p)) > MAX_SENTENCES)) if kind == "description" else F.lit(0)).alias("long_paragraphs"),
        (F.length(text) - F.length(F.replace(text, F.lit(";"), F.lit("")))).alias("semicolons"),
        F.regexp_count(text, F.lit(CONTRACTION)).alias("contractions"),
        F.size(ing).alias("ing_words"),
    )


def rule_table(spark, path: str) -> DataFrame:
    """The rule table of a JSON file, one row for each rule; parameters stay JSON text."""
    raw = spark.read.option("multiLine", True).schema("rules array<struct<id string, section struct<number int, title string>, title string, paraphrase string, check string, parameters string>>").json(path)
    return raw.select(F.inline("rules"))


def assembled(listed: DataFrame, authored: DataFrame) -> DataFrame:
    """Rules with their authored rows; ``gap`` names the side that lacks one."""
    both = listed.join(authored.withColumnRenamed("id", "a_id"), F.col("id") == F.col("a_id"), "full_outer")
    gap = F.when(F.col("id").isNull(), "not listed").when(F.col("a_id").isNull(), "not authored")
    return both.withColumn("gap", gap).withColumn("id", F.coalesce("id", "a_id")).drop("a_id")


def ing_allowed(rules: DataFrame) -> Column:
    """The approved -ing words of a rule table, a literal of at most some dozen words."""
    row = rules.filter("id = '3.5'").select(F.from_json(F.get_json_object("parameters", "$.ing_approved"), "array<string>").alias("w")).first()
    return F.array(*[F.lit(w.split(" ")[0]) for w in (row.w if row and row.w else ING_APPROVED)])


def vocabulary(words: DataFrame, approved: DataFrame, terms: DataFrame) -> DataFrame:
    """words (id, word, pos) -> also verdict, by the rules on vocabulary: ``listed`` (a form that the dictionary lists
    for the part of speech), ``plural`` (of an approved noun), ``term`` (a technical noun or verb), ``form`` (another form
    or part of speech of an approved word) or ``unknown``. approved: word, pos, forms, plural; terms: term."""
    low = F.lower(F.col("word"))
    forms = approved.select(F.col("pos").alias("f_pos"), F.explode(F.concat(F.array("word"), "forms")).alias("f")).select(F.lower("f").alias("form"), "f_pos").distinct()
    per = forms.groupBy("form").agg(F.collect_set("f_pos").alias("kinds"))
    plurals = approved.filter("plural IS NOT NULL AND pos = 'n'").select(F.lower("plural").alias("p_word")).distinct().withColumn("is_plural", F.lit(True))
    named = terms.select(F.lower("term").alias("t_word")).distinct().withColumn("is_term", F.lit(True))
    out = words.join(per, low == F.col("form"), "left").join(plurals, low == F.col("p_word"), "left").join(named, low == F.col("t_word"), "left")
    fits = F.col("pos").isNull() & F.col("form").isNotNull() | F.coalesce(F.array_contains("kinds", F.col("pos")), F.lit(False))
    noun = F.col("pos").isNull() | (F.col("pos") == "n")
    verdict = F.when(fits, "listed").when(F.coalesce("is_plural", F.lit(False)) & noun, "plural").when(F.coalesce("is_term", F.lit(False)), "term").when(F.col("form").isNotNull() | F.coalesce("is_plural", F.lit(False)), "form").otherwise("unknown")
    return out.select(*words.columns, verdict.alias("verdict"))
