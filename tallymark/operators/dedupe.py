"""One row per key, chosen by order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.identifiers import scan_id
from ..functions.text import build_report_text, report_length
from .columns import ID, canonical_id, col, order_column, require_columns

# Types whose aggregation buffer can be updated in place.
_FIXED_WIDTH = (T.NumericType, T.BooleanType, T.DateType, T.TimestampType)


def pick_by_order(
    df: DataFrame, keys: Sequence[str], columns: Sequence[str], order: Column, last: bool = False
) -> DataFrame:
    """For each key the values of its first (or last) row.

    This is a plain aggregate, so the rows of a hot key collapse before the
    shuffle. With fixed-width values each column has its own min_by and Spark
    uses a hash aggregate; otherwise one struct keeps the row together.
    """
    pick = F.max_by if last else F.min_by
    order_name = "_pick_order"
    slim = df.select(*[col(k) for k in keys], *[col(c) for c in columns], order.alias(order_name))
    grouped = slim.groupBy(*[col(k) for k in keys])
    if not columns:
        return slim.select(*[col(k) for k in keys]).distinct()
    if all(isinstance(df.schema[c].dataType, _FIXED_WIDTH) for c in columns):
        return grouped.agg(*[pick(col(c), col(order_name)).alias(c) for c in columns])
    row = pick(F.struct(*[col(c) for c in columns]), col(order_name))
    return grouped.agg(row.alias("_row")).select(*[col(k) for k in keys], "_row.*")


def dedupe_first(df: DataFrame, id_col: str = ID, order_by: str | None = None) -> DataFrame:
    """Keep the first row of every ID, in order of ``order_by``."""
    rest = [name for name in df.columns if name != id_col]
    kept = pick_by_order(df, [id_col], rest, order_column(df, order_by))
    return kept.select(*[col(name) for name in df.columns])


def keep_last(df: DataFrame, id_col: str = ID, order_by: str | None = None) -> DataFrame:
    """Keep the last row of every ID, in order of ``order_by``."""
    rest = [name for name in df.columns if name != id_col]
    kept = pick_by_order(df, [id_col], rest, order_column(df, order_by), last=True)
    return kept.select(*[col(name) for name in df.columns])


def unique_scans(
    df: DataFrame,
    report_columns: Sequence[str],
    keep_columns: Sequence[str] = (),
    order_by: str | None = None,
) -> DataFrame:
    """One row per scan: the reconstruction with the longest report text.

    Of equally long texts the first in order wins. ``VolumeName`` becomes the
    scan ID. Unknown ``keep_columns`` are ignored. The text moves through one
    shuffle, after each map task has already dropped its shorter candidates.
    """
    if not report_columns:
        raise ValueError("report_columns must name at least one column.")
    require_columns(df, [ID, *report_columns])
    extras = list(
        dict.fromkeys(c for c in keep_columns if c in df.columns and c not in (ID, "report_text"))
    )
    text = build_report_text([col(name) for name in report_columns])
    rows = df.select(
        scan_id(col(ID)).alias(ID),
        text.alias("report_text"),
        order_column(df, order_by).alias("_pick"),
        *[col(name) for name in extras],
    )
    preference = F.struct(report_length(col("report_text")), -col("_pick"))
    best = F.max_by(F.struct("report_text", *[col(name) for name in extras]), preference)
    return rows.groupBy(ID).agg(best.alias("_row")).select(ID, "_row.*")


__all__ = ["canonical_id", "dedupe_first", "keep_last", "pick_by_order", "unique_scans"]
