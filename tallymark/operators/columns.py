"""Schema-level helpers: name resolution, label discovery, row normalisation.

Everything here looks at schemas only; only ``fix_order`` can start a job.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..durable import materialise
from ..functions.coercion import round_half_even, safe_number, text_or_empty, to_binary_int

ID = "VolumeName"
ORDER = "_ord"

# Columns of a label run after its labels, and their kinds.
RUN_INTEGERS = ("prompt_tokens", "completion_tokens", "total_tokens", "retry_count")
RUN_DOUBLES = ("latency_seconds", "estimated_cost_usd")
RUN_METADATA = (
    "prompt_tokens",
    "completion_tokens",
    "total_tokens",
    "latency_seconds",
    "estimated_cost_usd",
    "model_version",
    "request_id",
    "retry_count",
    "started_at_utc",
    "ended_at_utc",
    "report_hash",
    "status",
    "error_message",
)
META_COLUMNS = (*RUN_METADATA, "report_text")
DEFAULT_EXCLUDE = (ID, "report_text")


def col(name: str) -> Column:
    """Column by exact name; names may hold spaces and dots."""
    return F.col("`" + name.replace("`", "``") + "`")


def resolve_column(df: DataFrame, name: str, prefer: str = "last") -> str:
    """Actual spelling of a column, compared without case.

    Among spellings that differ only in case, comparison and ensemble operators
    take the last one and labelling takes the first one.
    """
    matches = [c for c in df.columns if c.lower() == name.lower()]
    if not matches:
        raise KeyError(f"Column {name!r} not found (case-insensitive).")
    return matches[0] if prefer == "first" else matches[-1]


def canonical_id(df: DataFrame, id_col: str = ID, prefer: str = "first") -> DataFrame:
    """Rename the ID column, in any case, to VolumeName."""
    return df.withColumnRenamed(resolve_column(df, id_col, prefer), ID)


def require_columns(df: DataFrame, names: Iterable[str]) -> None:
    """Raise ValueError naming every column that is missing (exact spelling)."""
    missing = [name for name in names if name not in df.columns]
    if missing:
        raise ValueError(f"Missing required columns: {missing}")


def shared_labels(
    dfs: Sequence[DataFrame],
    labels: Sequence[str] | None = None,
    exclude: Iterable[str] = DEFAULT_EXCLUDE,
    order: str = "folded",
) -> list[str]:
    """Label columns all tables have, in the first table's spelling.

    An explicit list wins. ``order`` is ``folded`` (by lower-case name) or
    ``spelled`` (by the name as written).
    """
    wanted = [name.strip() for name in labels or () if name.strip()]
    if not wanted:
        hidden = {name.strip().lower() for name in exclude} | set(META_COLUMNS) | {ORDER}
        spelling = {name.lower(): name for name in dfs[0].columns}
        common = set(spelling).intersection(*[{c.lower() for c in df.columns} for df in dfs[1:]])
        wanted = [spelling[name] for name in sorted(common - {h.lower() for h in hidden})]
        if order == "spelled":
            wanted.sort()
    if not wanted:
        raise ValueError("No shared label columns found.")
    return wanted


def order_column(df: DataFrame, order_by: str | None) -> Column:
    """The column that stands for file order.

    Without a named one, or the ``_ord`` column a scan adds, the order of the
    rows as read is used; that is only meaningful right after a scan.
    """
    if order_by is not None:
        return col(order_by)
    if ORDER in df.columns:
        return col(ORDER)
    return F.monotonically_increasing_id()


def fix_order(df: DataFrame, order_by: str | None = None, name: str = ORDER) -> DataFrame:
    """``df`` with an order column ``name`` that is the same in every read.

    A named column, or the ``_ord`` of a scan, is data and stays as it is.
    Without either the rows are numbered as they are read and written out once:
    numbers worked out anew in each branch of a plan would not agree.
    """
    rest = [col(c) for c in df.columns if c != name]
    given = order_by if order_by is not None else ORDER if ORDER in df.columns else None
    if given is not None:
        return df.select(col(given).alias(name), *rest)
    return materialise(df.select(F.monotonically_increasing_id().alias(name), *rest))


def binary(df: DataFrame, name: str) -> Column:
    """A label column of ``df`` coerced to INT."""
    return to_binary_int(col(name), df.schema[name].dataType)


def prefix_columns(df: DataFrame, prefix: str, labels: Sequence[str]) -> list[Column]:
    """Label columns renamed to ``<prefix><label>``."""
    return [col(resolve_column(df, label)).alias(prefix + label) for label in labels]


def run_columns(labels: Sequence[str]) -> list[str]:
    """Column order of a label run."""
    return [ID, *labels, *RUN_METADATA]


def normalize_run_rows(
    df: DataFrame, labels: Sequence[str], cost_precision: int = 8, keep: Sequence[str] = ()
) -> DataFrame:
    """Project to the fixed label-run schema.

    Columns that are missing count as null. Numbers get 0, text gets "", and
    the cost is rounded. ``keep`` carries extra columns through unchanged.
    """

    def number(name: str) -> Column:
        if name not in df.columns:
            return F.lit(0.0)
        return safe_number(col(name), df.schema[name].dataType, 0.0)

    def column(name: str) -> Column:
        if name in labels:
            return number(name).cast("int")
        if name in RUN_INTEGERS:
            return number(name).cast("bigint")
        if name == "estimated_cost_usd":
            return round_half_even(number(name), cost_precision)
        if name in RUN_DOUBLES:
            return number(name)
        return text_or_empty(col(name)) if name in df.columns else F.lit("")

    projected = [column(name).alias(name) for name in run_columns(labels)]
    return df.select(*projected, *[col(name) for name in keep])
