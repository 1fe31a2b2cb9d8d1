"""Writing results."""

from __future__ import annotations

from pyspark.sql import DataFrame

_CSV = {
    "header": "true",
    "quote": '"',
    "escape": '"',
    "emptyValue": "",
    "nullValue": "",
    # The writer trims values unless told not to.
    "ignoreLeadingWhiteSpace": "false",
    "ignoreTrailingWhiteSpace": "false",
}


def write_labels(df: DataFrame, path: str) -> None:
    """Snapshot of a run: the whole table is replaced."""
    df.write.mode("overwrite").parquet(path)


def append_labels(df: DataFrame, path: str) -> None:
    """Add new rows to a run table."""
    df.write.mode("append").parquet(path)


def write_table(df: DataFrame, path: str, format: str = "parquet") -> None:
    """A derived table (metrics, discrepancies, agreement, consensus), replaced."""
    writer = df.write.mode("overwrite")
    if format == "csv":
        writer.options(**_CSV).csv(path)
    else:
        writer.format(format).save(path)


def write_summary(df: DataFrame, path: str) -> None:
    """A run summary or call log as JSON lines; null fields are left out."""
    df.write.mode("overwrite").json(path)
