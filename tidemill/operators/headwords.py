"""The word column of a dictionary: tokens, headwords with their forms, entries, alternatives; and listed rules."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemill.operators.layout import carried

# The tags of the word column, and those of alternatives.
HEAD_TAGS = ("n", "v", "adj", "adv", "prep", "pron", "art", "conj", "prefix")
ALT_TAGS = ("n", "v", "adj", "adv", "prep", "pron", "art", "conj", "TN", "TV")
SUMMARY = "Summary of the rules"
TRIMMED = " ,;:.-–…()"

TOKEN = rf"\((?:{'|'.join(HEAD_TAGS)})\)|[(),]|[^\s(),]+"
_TAG = rf"\((?:{'|'.join(ALT_TAGS)})\)"
#: Group 1: upper-case words with single blanks; 2: its own context before a tag; 3: the tag.
REFERENCE = rf"(?<![\w'’])([A-Z][A-Z0-9'’/\-]*(?: [A-Z0-9][A-Z0-9'’/\-]*)*)(?![\w'’])(?: \(([A-Z][A-Z ]*)\)(?= ?{_TAG}))?(?: ?\(({'|'.join(ALT_TAGS)})\))?"
CONTEXT = rf"\((?!(?:{'|'.join(ALT_TAGS)})\))[^()]*\)"
SECTION = r"^Section (\d+)\s*[–-]\s*(.+)$"
RULE = r"^Rule (\d+)\.(\d+)$"

# The grammar stands over one letter for each token: w word, p tag, o and c parentheses, k comma, n end of row.
_GROUP, _TAGGED = "o[wkn]*+c", "p|o[wkn]*+cn*+p"
_HEAD = re.compile(rf"(?P<run>(?:w|n(?!n))*+)(?:(?P<group>{_GROUP})n*+)?(?P<tag>p)?")
_FORMS = re.compile(rf"(?:k|(?=n*+w++k))(?P<list>(?:n*+w++k)*+(?:n*+w++(?!{_TAGGED}))?+)")
_AFTER_COMMA = re.compile(rf"n*+(?:o|w++(?:{_TAGGED}))")
_MORE = re.compile(rf"n*+(?P<group>{_GROUP})(?!n*+p)")
_KIND = {"(": "o", ")": "c", ",": "k"}


class HeadwordError(ValueError):
    pass


def head_tokens(head: Column) -> Column:
    """Tags, parentheses, commas and words of a row of the word column."""
    return F.regexp_extract_all(head, F.lit(f"({TOKEN})"), F.lit(1))


def parse(rows: list[tuple[list[str], bool]]) -> Iterator[tuple[str, str | None, str | None, list[str], int]]:
    """(tokens, ruled) of each row in order -> (word, qualifier, tag, forms, row) of each headword.

    Words that end at an empty row without a tag are a headword if a rule tops their row, else
    further forms of the headword before, one for each row.
    """
    said, row, letters = [], [], []
    for k, (tokens, _) in enumerate(rows):
        for t in [*tokens, "\n"]:
            said.append(t)
            row.append(k)
            letters.append("n" if t == "\n" else _KIND.get(t) or ("p" if t[0] == "(" else "w"))
    kinds = "".join(letters)

    def words(a: int, b: int) -> list[str]:
        return [said[i] for i in range(a, b) if kinds[i] == "w"]

    def inside(a: int, b: int) -> str:
        return " ".join(said[i] for i in range(a, b) if kinds[i] in "wk").replace(" ,", ",").strip()

    held, at = None, len(kinds) - len(kinds.lstrip("n"))
    while at < len(kinds):
        first, m = row[at], _HEAD.match(kinds, at)
        phrase, at = words(*m.span("run")), m.end()
        if not phrase:
            raise HeadwordError(f"no word at row {first}")
        group = inside(m.start("group") + 1, m.end("group") - 1) if m["group"] else None
        variant = group is not None and group.startswith("or ")
        qualifier, forms = (None, [group[3:]]) if variant else (group, [])
        tag = said[m.start("tag")][1:-1] if m["tag"] else None
        if tag is None:
            if kinds[at : at + 1] not in ("", "n") or group is not None:
                raise HeadwordError(f"no tag after {' '.join(phrase)} at row {first}")
            if held and not rows[first][1]:
                by_row: dict[int, list[str]] = {}
                for i in range(*m.span("run")):
                    if kinds[i] == "w":
                        by_row.setdefault(row[i], []).append(said[i])
                held[3].extend(map(" ".join, by_row.values()))
                while kinds[at : at + 1] == "n":
                    at += 1
                continue
        if m := _FORMS.match(kinds, at):
            start, at = m.start("list"), m.end()
            forms += [" ".join(words(start + x.start(), start + x.end())) for x in re.finditer("w+", m["list"])]
            if kinds[at - 1] == "k" and not _AFTER_COMMA.match(kinds, at):
                raise HeadwordError(f"empty form at row {row[at - 1]}")
        if m := _MORE.match(kinds, at):
            forms += [f.strip() for f in inside(m.start("group") + 1, m.end() - 1).removeprefix("also ").split(",") if f.strip()]
            at = m.end()
        if held:
            yield held
        held = (" ".join(phrase), qualifier, tag, forms, first)
        while kinds[at : at + 1] == "n":
            at += 1
    if held:
        yield held


def one_case(word: str, forms: list[str]) -> bool:
    """A headword is all upper or all lower case, and its forms are approved exactly if it is."""
    upper = lambda x: x == x.upper() != x.lower()
    return (upper(word) or word == word.lower()) and all(upper(f) == upper(word) for f in forms)


def headwords(rows: DataFrame) -> DataFrame:
    """rows (book, seq, head, ruled) -> book, seq of the first row, word, qualifier, tag, forms.

    A headword may follow on from any row before, so the rows of a book are read in order in one
    group: a book is some 10,000 rows, and books are spread. Mixed case fails as a misparse.
    """

    def run(book: pd.DataFrame) -> pd.DataFrame:
        book = book.sort_values("seq")
        seq, out = book.seq.tolist(), []
        for word, qualifier, tag, forms, first in parse([(list(t), bool(r)) for t, r in zip(book.tokens, book.ruled, strict=True)]):
            if not one_case(word, forms):
                raise HeadwordError(f"mixed case at {word}")
            out.append((book.book.iloc[0], seq[first], word, qualifier, tag, forms))
        return pd.DataFrame(out, columns=["book", "seq", "word", "qualifier", "tag", "forms"])

    kinds = f"book {rows.schema['book'].dataType.simpleString()}, seq long, word string, qualifier string, tag string, forms array<string>"
    read = rows.select("book", F.col("seq").cast("long").alias("seq"), "ruled", head_tokens(F.coalesce("head", F.lit(""))).alias("tokens"))
    return read.groupBy("book").applyInPandas(run, kinds)


ALTERNATIVES = "array<struct<kind: string, word: string, tag: string, context: string>>"


def alternatives(lines: Column) -> Column:
    """Lines of a cell -> struct of alternatives (kind word, technical or phrase) and the note left over.

    A tag alone on a line joins the line above; a group in parentheses is the context of the
    alternative before it.
    """
    text = F.regexp_replace(F.array_join(lines, "\n"), rf"\n(?={_TAG})", " ")
    found = F.regexp_extract_all(text, F.lit(f"({CONTEXT}|{REFERENCE})"), F.lit(1))
    part = lambda m, k: F.nullif(F.regexp_extract(m, REFERENCE, k), F.lit(""))

    def step(s: Column, m: Column) -> Column:
        context = F.trim(F.regexp_replace(F.substring(m, F.lit(2), F.length(m) - 2), r"\s+", " "))
        tag, last = part(m, 3), F.element_at(s["alts"], -1)
        kind = F.when(tag.isin("TN", "TV"), "technical").when(tag.isNotNull(), "word").otherwise("phrase")
        new = F.struct(kind.alias("kind"), part(m, 1).alias("word"), tag.alias("tag"), F.when(tag.isNotNull(), part(m, 2)).alias("context"))
        closed = F.struct(last["kind"].alias("kind"), last["word"].alias("word"), last["tag"].alias("tag"), context.alias("context"))
        is_context, some = F.startswith(m, F.lit("(")), F.size(s["alts"]) > 0
        alts = F.when(~is_context, F.concat(s["alts"], F.array(new))).when(some, F.concat(F.slice(s["alts"], F.lit(1), F.size(s["alts"]) - 1), F.array(closed))).otherwise(s["alts"])
        rest = F.when(is_context & ~some, F.concat(s["rest"], F.array(F.concat(F.lit("("), context, F.lit(")"))))).otherwise(s["rest"])
        return F.struct(alts.cast(ALTERNATIVES).alias("alts"), rest.cast("array<string>").alias("rest"))

    zero = F.struct(F.array().cast(ALTERNATIVES).alias("alts"), F.array().cast("array<string>").alias("rest"))
    got = F.aggregate(found, zero, step)
    left = F.concat(got["rest"], F.array(F.regexp_replace(text, f"{CONTEXT}|{REFERENCE}", " ")))
    note = F.trim(F.regexp_replace(F.array_join(left, " "), r"\s+", " "), F.lit(TRIMMED))
    return F.struct(got["alts"].alias("alternatives"), F.nullif(note, F.lit("")).alias("note"))


def bodies(rows: DataFrame, heads: DataFrame) -> DataFrame:
    """Each row with ``entry``, the first row of the headword it belongs to; rows before the first go."""
    at = heads.select("book", F.col("seq").cast("long").alias("seq")).distinct().withColumn("entry", F.col("seq"))
    return carried(rows.withColumn("seq", F.col("seq").cast("long")).join(at, ["book", "seq"], "left"), "book", "seq", "entry").filter("entry IS NOT NULL")


def entries(rows: DataFrame) -> DataFrame:
    """rows (book, seq, page, head, ruled, main, help, ste, nonste) -> an entry for each headword.

    An approved entry's lines of references alone that stand at or after its first help line are
    alternatives, its other lines the meaning; all lines of another entry are read for alternatives.
    """
    heads = headwords(rows)
    order = Window.partitionBy("book", "entry").orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    approved = (F.col("word") == F.upper("word")) & (F.col("word") != F.lower("word"))
    body = bodies(rows, heads).join(heads.withColumnRenamed("seq", "entry"), ["book", "entry"])
    body = body.withColumn("helped", F.max(F.coalesce(F.col("help") != "", F.lit(False))).over(order)).withColumn("approved", approved)
    bare = ~F.regexp_replace("main", _TAG, "").rlike("[a-z]")
    body = body.withColumn("is_alt", ~F.col("approved") | (F.col("helped") & bare))
    said = lambda c, when=F.lit(True): F.transform(F.array_sort(F.collect_list(F.when((F.col(c) != "") & when, F.struct("seq", c)))), lambda x: x[c])
    text = lambda c: F.nullif(F.array_join(said(c), " "), F.lit("")).alias(c)
    out = body.groupBy("book", "entry", "word", "qualifier", "tag", "forms", "approved").agg(
        F.min_by("page", "seq").alias("page"), F.array_join(said("main", ~F.col("is_alt")), " ").alias("meaning"), said("main", F.col("is_alt")).alias("lines"), text("help"), text("ste"), text("nonste")
    )
    alts = alternatives(F.col("lines"))
    return out.select(
        "book", "entry", "page", "word", "qualifier", F.col("tag").alias("pos"), "forms", F.when(F.col("approved"), "approved").otherwise("unapproved").alias("kind"),
        F.when(F.col("approved"), F.col("meaning")).alias("meaning"), "help", alts["alternatives"].alias("alternatives"), F.when(~F.col("approved"), alts["note"]).alias("note"), "ste", "nonste",
    )


def from_rows(rows: DataFrame) -> DataFrame:
    """Page rows (book, page, group_no, head, ...) numbered over a book, with heads joined over line-end hyphens.

    A head that ends in a letter and a hyphen takes the next row's head where that starts with a letter; the next row
    keeps its other cells. Of heads in a row that would each take the next, every second does.
    """
    book = Window.partitionBy("book").orderBy("page", "group_no")
    d = rows.withColumn("seq", F.row_number().over(book).cast("long"))
    joins = F.coalesce(F.lag("head").over(book).rlike("[A-Za-z]-$") & F.col("head").rlike("^[A-Za-z]"), F.lit(False))
    d = d.withColumn("joins", joins).withColumn("free", F.max(F.when(~F.col("joins"), F.col("seq"))).over(book.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    d = d.withColumn("taken", F.col("joins") & ((F.col("seq") - F.col("free")) % 2 == 1))
    d = d.withColumns({"next_head": F.lead("head").over(book), "next_taken": F.coalesce(F.lead("taken").over(book), F.lit(False))})
    head = F.when(F.col("taken"), "").when(F.col("next_taken"), F.concat(F.regexp_replace("head", "-$", ""), "next_head")).otherwise(F.col("head"))
    return d.withColumn("head", head).drop("joins", "free", "taken", "next_head", "next_taken")


def listed_rules(lines: DataFrame) -> DataFrame:
    """lines (book, page, seq, size, bold, text) of summary pages -> the rules they list.

    A page counts from its section line to the first large heading behind it. Section and heading
    hold for the rules that follow; a rule's statement is the lines up to the next rule, heading or section.
    """
    page = Window.partitionBy("book", "page").orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    is_section = F.col("text").rlike(SECTION)
    d = lines.withColumn("on", F.max(is_section).over(page))
    d = d.withColumn("off", F.max(F.col("on") & ~is_section & (F.col("size") >= 12) & (F.col("text") != SUMMARY)).over(page)).filter("on AND NOT off")
    d = d.filter(F.col("text") != SUMMARY)
    is_rule = F.col("text").rlike(RULE)
    is_heading = ~is_section & ~is_rule & F.col("bold") & (F.col("size") < 13)
    book = Window.partitionBy("book").orderBy("page", "seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    kept = lambda when, value: F.last(F.when(when, value), True).over(book)
    d = d.withColumns({
        "section": F.coalesce(kept(is_section, F.regexp_extract("text", SECTION, 1).cast("int")), F.lit(0)), "section_title": kept(is_section, F.trim(F.regexp_extract("text", SECTION, 2))),
        "title": F.coalesce(kept(is_heading, F.col("text")), F.lit("")), "part": F.sum((is_section | is_rule | is_heading).cast("int")).over(book),
        "id": F.when(is_rule, F.regexp_replace("text", "^Rule ", "")),
    })
    text = F.transform(F.array_sort(F.collect_list(F.when(F.col("id").isNull(), F.struct("page", "seq", "text")))), lambda x: x["text"])
    return d.groupBy("book", "part").agg(F.max("id").alias("id"), F.first("section").alias("section"), F.first("section_title").alias("section_title"), F.first("title").alias("title"), F.array_join(text, " ").alias("statement")).filter("id IS NOT NULL").drop("part")
