"""Report text expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .coercion import strip_space


def report_hash(text: Column) -> Column:
    """Lower-case hex SHA-256 of the text, empty for null."""
    return F.coalesce(F.sha2(text, 256), F.lit(""))


def report_length(text: Column) -> Column:
    """Length in characters, 0 for null."""
    return F.coalesce(F.length(text), F.lit(0))


def build_report_text(parts: list[Column]) -> Column:
    """Non-blank parts, stripped, with a blank line between them."""
    stripped = F.array(*[strip_space(F.coalesce(p.cast("string"), F.lit(""))) for p in parts])
    return F.array_join(F.filter(stripped, lambda part: part != ""), "\n\n")
