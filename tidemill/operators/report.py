"""Text forms of results: table lines, shares, the nested JSON of a validation, run identifiers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def share(n: Column, total: Column) -> Column:
    """Percentage with one decimal, n/a without a denominator."""
    return F.when(total != 0, F.format_string("%.1f%%", (100 * n / total).cast("double"))).otherwise("n/a")


def table_line(*cells: Column | str) -> Column:
    return F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |"))


def table_head(*names: str) -> str:
    return f"| {' | '.join(names)} |\n|{' --- |' * len(names)}"


def detail_json() -> Column:
    """side, entry, text, seconds, items -> one JSON object; null members stay."""
    return F.to_json(F.struct("side", "entry", "text", F.round("seconds", 3).alias("seconds"), "items"), {"ignoreNullFields": "false"})


def run_id(backend: Column, model: Column, at: Column) -> Column:
    """Backend, last part of the model name as a slug, UTC stamp."""
    slug = F.regexp_replace(F.regexp_replace(F.substring_index(model, "/", -1), "[^A-Za-z0-9.]+", "-"), "^-+|-+$", "")
    return F.concat_ws("-", backend, slug, F.date_format(at, "yyyyMMdd'T'HHmmss'Z'"))
