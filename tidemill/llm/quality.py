r"""Quality rules: a threshold table compiled into one Spark projection, without user functions.

Measures of a text: words ``[^\x20\x09-\x0D]+``, code points in words, symbols, lines that repeat
an earlier line, words in three-word windows that occur twice or more (windows are compared by a
64-bit hash of their words, within one text), stop words in any case of letters. The rule table
bounds ratios of them; a row whose base rule fails is not kept, else the table decides.

Defined cases: a null or empty text has no words, fails the base rule and has zero for every count;
repeated rows are judged alike; an empty table gives no rows; other columns are ignored, whatever
their names. A very long text is judged whole, in arrays of its words.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.llm.common import table, texts

SYMBOLS = "#*$%&|<>"
#: Frequent words of the languages that are judged, in lower case.
STOP_WORDS = (
    "the", "of", "and", "to", "in", "is", "that", "for", "it", "as", "was", "with", "on", "by", "be", "this", "are", "from", "at", "or",
    "de", "la", "le", "et", "les", "des", "un", "une", "du", "en", "que", "qui", "pour", "dans", "sur", "pas", "est", "par", "au", "avec",
    "der", "die", "und", "das", "den", "von", "zu", "mit", "sich", "auf", "ist", "nicht", "ein", "eine", "dem", "des", "im", "für", "auch", "es",
    "el", "los", "las", "y", "del", "se", "con", "no", "su", "para", "una", "al", "lo", "como", "más", "o", "pero", "sus", "ha", "me",
)
#: (name, numerator, per, relation, factor): numerator <relation> factor * per, and the row is rejected.
THRESHOLDS = (
    ("few_letters", "word_chars", "n_words", "<", 2.0),
    ("long_words", "word_chars", "n_words", ">", 20.0),
    ("symbols", "n_symbols", "n_words", ">", 0.3),
    ("shouting", "n_marks", "n_words", ">", 0.5),
    ("few_stop_words", "n_stop_words", "n_words", "<", 0.06),
    ("repeated_lines", "n_dup_lines", "n_lines", ">", 0.5),
)
MIN_WORDS, MAX_REPEAT = 50, 50


def _count(text: Column, chars: str) -> Column:
    return (F.length(text) - F.length(F.translate(text, chars, ""))).cast("long")


def measures(docs: DataFrame) -> DataFrame:
    at = lambda a, i: F.get(F.col(a), i)
    d = texts(docs).withColumn("flat", F.trim(F.translate("text", "\t\n\x0b\x0c\r", "     ")))
    d = d.withColumn("words", F.when(F.col("flat") == "", F.array().cast("array<string>")).otherwise(F.split("flat", " +")))
    d = d.withColumn("lines", F.filter(F.split("text", "\n"), lambda x: F.trim(F.translate(x, "\t\x0b\x0c\r", "    ")) != ""))
    d = d.withColumn("n_words", F.size("words").cast("long"))
    windows = F.transform(F.sequence(F.lit(0), F.size("words") - 3), lambda i: F.struct(F.xxhash64(at("words", i), at("words", i + 1), at("words", i + 2)).alias("h"), i.alias("i")))
    d = d.withColumn("windows", F.when(F.size("words") >= 3, F.array_sort(windows)))
    d = d.withColumn("hits", F.array_sort(F.transform(
        F.filter("windows", lambda x, j: F.coalesce(x["h"] == F.get("windows", j - 1)["h"], F.lit(False)) | F.coalesce(x["h"] == F.get("windows", j + 1)["h"], F.lit(False))),
        lambda x: x["i"])))
    covered = F.aggregate(F.transform("hits", lambda p, j: F.least(F.lit(3), F.coalesce(at("hits", j + 1) - p, F.lit(3)))), F.lit(0), lambda s, x: s + x)
    return d.select(
        "doc_id",
        "n_words",
        F.length(F.translate("flat", " ", "")).cast("long").alias("word_chars"),
        _count(F.col("text"), SYMBOLS).alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"),
        F.size("lines").cast("long").alias("n_lines"),
        _count(F.col("text"), "!?").alias("n_marks"),
        F.size(F.filter(F.split(F.lower("flat"), " +"), lambda w: w.isin(*dict.fromkeys(STOP_WORDS)))).cast("long").alias("n_stop_words"),
    )


def verdicts(measured: DataFrame, thresholds=THRESHOLDS) -> DataFrame:
    """base_failed, kept and the names of the rules that a row breaks."""
    base = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT * F.col("n_words"))

    def broken(rule) -> Column:
        name, what, per, relation, factor = rule
        bound = F.lit(factor) * F.col(per)
        return F.col(what) < bound if relation == "<" else F.col(what) > bound

    named = F.array_compact(F.array(*[F.when(broken(r), F.lit(r[0])) for r in thresholds]))
    any_broken = reduce(lambda a, b: a | b, map(broken, thresholds))
    return measured.withColumns({"base_failed": base, "kept": ~base & ~any_broken, "broken": named})


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verdicts(measures(table(spark, sf_dir, "documents"))).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def _rule_sql(rule) -> str:
    name, what, per, relation, factor = rule
    return f"({what} {relation} {factor} * {per})"


ORACLE_OP8 = rf"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, row_number() OVER () AS rid FROM documents
), w AS (
  SELECT rid, doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words,
    list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d
), g AS (
  SELECT rid, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS gram
  FROM w, LATERAL (SELECT unnest(range(1, len(words) - 1)) AS i)
), hit AS (
  SELECT rid, i FROM g QUALIFY count(*) OVER (PARTITION BY rid, gram) > 1
), covered AS (
  SELECT rid, count(DISTINCT i + k) AS n FROM hit, range(3) x(k) GROUP BY rid
), m AS (
  SELECT doc_id, len(words) AS n_words, coalesce(list_sum(list_transform(words, lambda x: length(x))), 0)::BIGINT AS word_chars,
    length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
    (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(covered.n, 0) AS n_repeat_words, len(lines) AS n_lines,
    length(text) - length(regexp_replace(text, '[!?]', '', 'g')) AS n_marks,
    len(list_filter(words, lambda x: lower(x) IN ({", ".join(f"'{x}'" for x in dict.fromkeys(STOP_WORDS))}))) AS n_stop_words
  FROM w LEFT JOIN covered USING (rid)
), b AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT} * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT ({" OR ".join(map(_rule_sql, THRESHOLDS))}) AS kept FROM b
"""
