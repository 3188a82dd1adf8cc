"""Checks of built artifacts against each other and against the text they come from: each gives its faults as rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemill.operators.layout import joined_text

#: Words for numbers in the rule statements.
NUMBER_WORDS = {"one": 1, "three": 3, "four": 4, "six": 6, "twenty-two": 22}
#: Rule, parameter, the pattern that captures the stated number, and where to look for it: in the
#: rule's statement, in all of the text, or behind the rule's heading in the text. A list stands for its length.
PARAMETERS = (
    ("5.1", "max_words_per_sentence", r"maximum of (\d+) words", "statement"),
    ("6.3", "max_words_per_sentence", r"maximum of (\d+) words", "statement"),
    ("6.6", "max_sentences_per_paragraph", r"more than (\w+) sentences", "statement"),
    ("2.1", "max_words_in_multi_word_noun", r"no more than (\w+) words", "statement"),
    ("2.2", "max_words_in_multi_word_noun", r"more than (\w+) words", "statement"),
    ("5.1", "notes_max_words_per_sentence", r"sentence in a note is (\d+) words", "text"),
    ("8.5", "parenthetical_counts_as_words", r"counts as (one) word in that sentence", "statement"),
    ("8.7", "hyphenated_counts_as_words", r"count as (one) word", "statement"),
    ("1.5", "technical_noun_categories", r"one or more of these ([\w-]+) categories", "section"),
    ("1.12", "technical_verb_categories", r"one or more of these ([\w-]+) categories", "section"),
)
#: How far a section reaches behind its heading, the heading of the list of -ing words and its reach.
SECTION_CHARS, ING_HEADING, ING_CHARS = 6000, "Approved words that have an “-ing” form", 600
#: Parts of speech that an entry may have.
POS_TAGS = ("n", "v", "adj", "adv", "prep", "pron", "art", "conj", "prefix")


def stated(text: Column, pattern: Column) -> Column:
    """The number that a pattern captures, in digits or as one of NUMBER_WORDS; null where it is not stated."""
    word = F.get(F.regexp_extract_all(text, pattern, F.lit(1)), 0)
    named = F.create_map(*[F.lit(x) for kv in NUMBER_WORDS.items() for x in kv])
    return F.coalesce(word.try_cast("int"), F.element_at(named, word))


def behind(text: Column, mark: Column, which: int, size: int) -> Column:
    """The size characters from the which-th place of mark on; empty where it does not stand so often."""
    at = F.position(mark, text)
    for _ in range(which - 1):
        at = F.when(at > 0, F.position(mark, text, at + 1)).otherwise(0)
    return F.when(at > 0, F.substring(text, at, F.lit(size))).otherwise("")


def parameter_faults(rules: DataFrame, text: DataFrame, checks: tuple[tuple[str, str, str, str], ...] = PARAMETERS) -> DataFrame:
    """rule, parameter, value, stated where they differ. rules: id, statement, parameters (JSON); text: one row."""
    spark = rules.sparkSession
    # one row for each check and one text of a book: both sides have a fixed size
    asked = spark.createDataFrame(list(checks), "rule string, parameter string, pattern string, scope string")
    both = rules.join(F.broadcast(asked), F.col("id") == F.col("rule")).join(F.broadcast(text.select(F.col("text").alias("whole")).limit(1)), F.lit(True))
    section = behind(F.col("whole"), F.concat(F.lit("Rule "), "rule", F.lit(" ")), 2, SECTION_CHARS)
    where = F.when(F.col("scope") == "statement", F.col("statement")).when(F.col("scope") == "text", F.col("whole")).otherwise(section)
    raw = F.element_at(F.from_json("parameters", "map<string,string>"), F.col("parameter"))
    value = F.when(F.substring(F.ltrim(raw), 1, 1) == "[", F.json_array_length(raw)).otherwise(raw.try_cast("int"))
    told = both.select("rule", "parameter", value.alias("value"), stated(where, F.col("pattern")).alias("stated"))
    return told.filter(~F.col("value").eqNullSafe(F.col("stated")))


def header_faults(artifacts: DataFrame, version: int, source: dict[str, object]) -> DataFrame:
    """name, fault of the artifacts (name, schema_version, source map) that have another header."""
    want = F.create_map(*[F.lit(str(x)) for kv in source.items() for x in kv])
    ordered = lambda m: F.array_sort(F.map_entries(m))
    faults = F.array_compact(F.array(
        F.when(~F.col("schema_version").eqNullSafe(F.lit(version)), F.lit("schema_version")),
        F.when(~ordered(F.col("source")).eqNullSafe(ordered(want)), F.lit("source")),
    ))
    return artifacts.select("name", F.explode(faults).alias("fault"))


def verb_list(spans: DataFrame) -> DataFrame:
    """word of the spans (page, text, size, bold) on the pages that list the approved verbs: small plain text."""
    whole = spans.groupBy("page").agg(F.concat_ws(" ", F.collect_list("text")).alias("t"))
    pages = whole.filter(F.contains("t", F.lit("List of approved verbs")) & F.contains("t", F.lit("Page 2-0-"))).select("page")
    return spans.join(pages, "page", "left_semi").filter("size < 10.5 AND NOT bold AND trim(text) <> ''").select(F.trim("text").alias("word")).distinct()


def text_of_pages(lines: DataFrame, label: str = r"Page 1-\d+-\d+") -> DataFrame:
    """text: the lines (page, seq, text) of the pages whose label fits, in order, white space collapsed. One book, one row."""
    pages = lines.filter(F.col("text").rlike(label)).select("page").distinct()
    kept = lines.join(pages, "page", "left_semi")
    return kept.groupBy().agg(F.trim(F.regexp_replace(joined_text("page", "seq"), r"\s+", " ")).alias("text"))


def set_gaps(listed: DataFrame, parsed: DataFrame) -> DataFrame:
    """word, side of the words that only one of two lists has."""
    a, b = listed.select("word").distinct(), parsed.select("word").distinct()
    return a.exceptAll(b).withColumn("side", F.lit("listed")).unionByName(b.exceptAll(a).withColumn("side", F.lit("parsed")))


def ing_faults(ing: DataFrame, approved: DataFrame, text: DataFrame) -> DataFrame:
    """id, fault of the approved -ing ids that are no entry or are not named in the text's list of them."""
    known = approved.select(F.col("id").alias("k_id"), F.lit(True).alias("known")).distinct()
    part = text.select(behind(F.col("text"), F.lit(ING_HEADING), 1, ING_CHARS).alias("part")).limit(1)
    both = ing.select("id").join(known, F.col("id") == F.col("k_id"), "left").join(F.broadcast(part), F.lit(True), "left")
    faults = F.array_compact(F.array(F.when(F.col("known").isNull(), F.lit("not an entry")), F.when(~F.contains(F.coalesce("part", F.lit("")), F.split("id", " ")[0]), F.lit("not named"))))
    return both.select("id", F.explode(faults).alias("fault"))


def entry_faults(entries: DataFrame) -> DataFrame:
    """word, fault: the case of an entry (word, pos, approved) against its status, and its part of speech."""
    upper = (F.col("word") == F.upper("word")) & (F.col("word") != F.lower("word"))
    faults = F.array_compact(F.array(
        F.when(upper != F.col("approved"), F.lit("case")),
        F.when((F.col("pos") == "prefix") & ~F.col("word").endswith("-"), F.lit("prefix")),
        F.when(F.col("pos").isNotNull() & ~F.col("pos").isin(*POS_TAGS), F.lit("pos")),
    ))
    return entries.select("word", F.explode(faults).alias("fault"))


def dictionary_counts(entries: DataFrame) -> DataFrame:
    """One row: entries (word, pos), distinct pairs of both, distinct words in lower case."""
    return entries.agg(F.count("*").alias("entries"), F.countDistinct("word", "pos").alias("keys"), F.countDistinct(F.lower("word")).alias("words"))


def dead_ends(unapproved: DataFrame) -> DataFrame:
    """word, pos of the entries without an alternative and without help."""
    return unapproved.filter("size(alternatives) = 0 AND coalesce(help, '') = ''").select("word", "pos")


def notes(unapproved: DataFrame, approved: DataFrame) -> DataFrame:
    """note, word, detail: alternatives that state another part of speech than their entry, and words of phrase
    alternatives outside the lexicon. unapproved: word, alternatives (ref, stated_pos, phrase); approved: forms."""
    each = unapproved.select("word", F.explode("alternatives").alias("a"))
    other = each.filter("a.stated_pos IS NOT NULL").select(F.lit("stated_pos").alias("note"), "word", F.col("a.stated_pos").alias("detail"))
    words = each.filter("a.phrase IS NOT NULL").select(F.explode(F.split("a.phrase", r"\s+")).alias("detail")).filter("detail <> ''").distinct()
    outside = words.join(approved.select(F.explode("forms").alias("detail")).distinct(), "detail", "left_anti")
    return other.unionByName(outside.select(F.lit("outside").alias("note"), F.lit(None).cast("string").alias("word"), "detail"))


def report(**checks: DataFrame) -> DataFrame:
    """check, fault of several fault tables: any row is a failure."""
    told = [d.select(F.lit(name).alias("check"), F.to_json(F.struct(*d.columns)).alias("fault")) for name, d in checks.items()]
    out = told[0]
    for d in told[1:]:
        out = out.unionByName(d)
    return out
