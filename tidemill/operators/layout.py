"""Order-dependent steps over positioned words: rows by gaps, columns, bands, spans, ranges, carries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemill.operators.scan import LARGE_KEY, Take, free, ordered


def gap_groups(rows: DataFrame, by: str, at: Column, gap: float, order: list, large: int = LARGE_KEY) -> DataFrame:
    """Number of the chained group: a new one where the gap to the row before is larger than ``gap``."""
    (before,) = free(rows, "before")
    scan = ordered(rows, [by], order, large).take(**{before: Take("lag", at)})
    new = F.coalesce(at - F.col(before) > gap, F.lit(True)).cast("int")
    return scan.take(group_no=Take("sum", new)).result().drop(before)


#: How far left of a column a word may start, how far in help text starts, gap between rows, reach of a rule line.
SLACK, HELP_INDENT, ROW_GAP, RULE_ABOVE, RULE_BELOW = 12.0, 29.0, 2.5, 7.0, 2.0


def page_rows(words: DataFrame, pages: DataFrame, rules: DataFrame) -> DataFrame:
    """page, group_no, y, ruled, head, main, help, ste, nonste: the rows of dictionary pages.

    words: page, x, y, text, bold; pages: page, starts (of the four columns); rules: page, y of the lines. Words of one row
    are chained by their gaps; of the first column only bold words count; a second column that starts
    far enough in is help.
    """
    placed = gap_groups(words, "page", F.col("y"), ROW_GAP, ["y", "x", "text"]).join(pages.select("page", "starts"), "page")
    at = lambda k: F.col("x") >= F.get("starts", k) - SLACK
    cell = F.when(at(3), "nonste").when(at(2), "ste").when(at(1), "main").when(F.col("bold"), "head")
    line = lambda n: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("cell") == n, F.struct("x", "text")))), lambda w: w["text"]), " ")
    rows = placed.withColumn("cell", cell).groupBy("page", "group_no").agg(
        F.min("y").alias("y"), *[line(n).alias(n) for n in ("head", "main", "ste", "nonste")], F.min(F.when(F.col("cell") == "main", F.col("x"))).alias("main_x"), F.first("starts").alias("starts")
    )
    is_help = F.coalesce(F.col("main_x") >= F.get("starts", 1) + HELP_INDENT, F.lit(False))
    lined = band_join(rows, rules, RULE_ABOVE, RULE_BELOW)
    return lined.select("page", "group_no", "y", F.col("rule").isNotNull().alias("ruled"), "head", F.when(is_help, "").otherwise(F.col("main")).alias("main"), F.when(is_help, F.col("main")).otherwise("").alias("help"), "ste", "nonste")


def carried(rows: DataFrame, by: str, order: str, *names: str, large: int = LARGE_KEY) -> DataFrame:
    """The last value that is not null, up to this row."""
    return ordered(rows, [by], [order], large).take(**{n: Take("last", F.col(n)) for n in names}).result()


def band_join(rows: DataFrame, rules: DataFrame, below: float, above: float) -> DataFrame:
    """For each row (page, y) the first rule line from y - below to y + above on the page, or null.

    Rule lines are put into cells as wide as the band, so a row meets those of at most two cells
    by equality.
    """
    width = below + above
    cell = lambda y: F.floor(y / width).cast("long")
    spread = rows.select("page", "y", F.explode(F.array_distinct(F.array(cell(F.col("y") - below), cell(F.col("y") + above)))).alias("cell"))
    lines = rules.select(F.col("page").alias("r_page"), F.col("y").alias("rule"), cell(F.col("y")).alias("r_cell"))
    inside = (F.col("rule") >= F.col("y") - below) & (F.col("rule") <= F.col("y") + above)
    hit = spread.join(lines, (F.col("page") == F.col("r_page")) & (F.col("cell") == F.col("r_cell")) & inside).groupBy("page", "y").agg(F.min("rule").alias("rule"))
    return rows.join(hit, ["page", "y"], "left")


def asof_spans(words: DataFrame, spans: DataFrame, large: int = LARGE_KEY) -> DataFrame:
    """For each word (row, mid) the first span of its row whose right edge is not left of it, else the last.

    One ordered scan of words and spans together, no range join.
    """
    both = spans.select("row", F.col("right").alias("at"), F.lit(1).alias("kind"), F.col("span"), F.lit(None).cast("long").alias("word")).unionByName(
        words.select("row", F.col("mid").alias("at"), F.lit(0).alias("kind"), F.lit(None).cast("string").alias("span"), "word")
    )
    nearest = ordered(both, ["row"], ["at", "kind", "span", "word"], large).take(after=Take("next", F.col("span")), before=Take("last", F.col("span")))
    return nearest.result().filter("kind = 0").select("row", "word", F.coalesce("after", "before").alias("hit"))


def soft_hyphens(rows: DataFrame, by: str, order: str, large: int = LARGE_KEY) -> DataFrame:
    """Rows joined over line-end hyphens: a row that ends in a letter and a hyphen takes the next row where
    that starts with a letter; chains join in one piece."""
    (before,) = free(rows, "before")
    scan = ordered(rows, [by], [order], large).take(**{before: Take("lag", F.col("text"))})
    joins = F.coalesce(F.col(before).rlike("[A-Za-z]-$") & F.col("text").rlike("^[A-Za-z]"), F.lit(False))
    d = scan.take(piece=Take("sum", (~joins).cast("int"))).result()
    parts = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col("text").alias("t"))))
    text = F.aggregate(parts, F.lit(""), lambda s, x: F.concat(F.when((s != "") & s.rlike("[A-Za-z]-$"), F.regexp_replace(s, "-$", "")).otherwise(s), x["t"]))
    return d.groupBy(by, "piece").agg(text.alias("text"), F.min(order).alias(order))


def joined_text(*order: str) -> Column:
    """The texts of a group in order, joined by spaces."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*order, "text"))), lambda x: x["text"]), " ")
