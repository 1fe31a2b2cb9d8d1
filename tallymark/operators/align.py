"""Lining up label tables by normalised ID."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.identifiers import IdRule
from .columns import (
    DEFAULT_EXCLUDE,
    ID,
    ORDER,
    binary,
    col,
    order_column,
    prefix_columns,
    resolve_column,
    shared_labels,
)
from .dedupe import pick_by_order

IN_LEFT = "_in_left"
IN_RIGHT = "_in_right"
WEIGHT = "_weight"


def normalize_ids(df: DataFrame, id_col: str = ID, rule: IdRule = IdRule()) -> DataFrame:
    """Replace the ID column, found in any case, by a normalised VolumeName."""
    source = resolve_column(df, id_col)
    others = [col(name) for name in df.columns if name != source]
    return df.select(rule.apply(col(source)).alias(ID), *others)


def pair_labels(
    left: DataFrame,
    right: DataFrame,
    labels: Sequence[str] | None = None,
    exclude: Sequence[str] = DEFAULT_EXCLUDE,
) -> list[str]:
    """Labels two tables share, ordered by name as spelled in the left one."""
    return shared_labels([left, right], labels, exclude, order="spelled")


def pair_table(
    left: DataFrame,
    right: DataFrame,
    labels: Sequence[str],
    *,
    left_id: str = ID,
    right_id: str = ID,
    rule: IdRule = IdRule(),
    left_order: str | None = None,
    right_order: str | None = None,
) -> DataFrame:
    """Full outer pairing: one row per ID with raw ``true_*`` and ``pred_*`` values.

    ``_in_left`` and ``_in_right`` tell where the ID occurs. Each side is
    pruned and deduplicated before the join, and the join runs on the key both
    aggregates are already partitioned by, so each side is shuffled once.
    """
    sides = []
    for df, id_col, order_by, prefix, flag in (
        (left, left_id, left_order, "true_", IN_LEFT),
        (right, right_id, right_order, "pred_", IN_RIGHT),
    ):
        slim = _side(df, id_col, order_by, prefix, labels, rule)
        names = [prefix + label for label in labels]
        first = pick_by_order(slim, [ID], names, col(ORDER))
        sides.append(first.withColumn(flag, F.lit(True)))
    joined = sides[0].join(sides[1], ID, "full_outer")
    return joined.fillna(False, [IN_LEFT, IN_RIGHT])


def align_pair(
    left: DataFrame,
    right: DataFrame,
    labels: Sequence[str],
    *,
    left_id: str = ID,
    right_id: str = ID,
    rule: IdRule = IdRule(),
    left_order: str | None = None,
    right_order: str | None = None,
) -> DataFrame:
    """Inner pairing of two label tables on the normalised ID.

    Dropping reconstruction suffixes also drops repeated IDs. When they are
    kept nothing is dropped and every left row meets every right row of its ID;
    that product is kept as a ``_weight`` per pair of distinct label patterns
    instead of being written out.
    """
    if not rule.keep_reconstruction_suffix:
        table = pair_table(
            left,
            right,
            labels,
            left_id=left_id,
            right_id=right_id,
            rule=rule,
            left_order=left_order,
            right_order=right_order,
        )
        return table.where(col(IN_LEFT) & col(IN_RIGHT)).drop(IN_LEFT, IN_RIGHT)
    counted = []
    for df, id_col, prefix, count in (
        (left, left_id, "true_", "_left_rows"),
        (right, right_id, "pred_", "_right_rows"),
    ):
        slim = _side(df, id_col, None, prefix, labels, rule).drop(ORDER)
        counted.append(slim.groupBy(*[col(c) for c in slim.columns]).agg(F.count("*").alias(count)))
    joined = counted[0].join(counted[1], ID)
    weight = (col("_left_rows") * col("_right_rows")).alias(WEIGHT)
    values = [col(c) for c in joined.columns if c not in ("_left_rows", "_right_rows")]
    return joined.select(*values, weight)


def unmatched_ids(
    left: DataFrame,
    right: DataFrame,
    *,
    left_id: str = ID,
    right_id: str = ID,
    rule: IdRule = IdRule(),
) -> DataFrame:
    """Distinct IDs only one table has, with the side they come from."""
    marked = normalize_ids(left, left_id, rule).select(ID, F.lit(1).alias("_side"))
    marked = marked.unionByName(normalize_ids(right, right_id, rule).select(ID, F.lit(2).alias("_side")))
    sides = marked.groupBy(ID).agg(F.min("_side").alias("_lo"), F.max("_side").alias("_hi"))
    side = F.when(col("_lo") == 1, F.lit("left_only")).otherwise(F.lit("right_only"))
    return sides.where(col("_lo") == col("_hi")).select(ID, side.alias("side"))


def align_runs(
    runs: Mapping[str, DataFrame],
    labels: Sequence[str] | None = None,
    *,
    id_col: str = ID,
    rule: IdRule = IdRule(),
    exclude: Sequence[str] = DEFAULT_EXCLUDE,
    order_by: str | None = None,
) -> DataFrame:
    """IDs every run has, with INT columns ``<run>__<label>``.

    Each run is deduplicated first; all joins share the key the aggregates are
    partitioned by, so N runs cost N shuffles and no more.
    """
    if len(runs) < 2:
        raise ValueError("Provide at least two label runs.")
    names = shared_labels(list(runs.values()), labels, exclude)
    aligned = None
    for run, df in runs.items():
        values = [binary(df, resolve_column(df, label)).alias(f"{run}__{label}") for label in names]
        slim = df.select(
            rule.apply(col(resolve_column(df, id_col))).alias(ID),
            order_column(df, order_by).alias(ORDER),
            *values,
        )
        first = pick_by_order(slim, [ID], [f"{run}__{label}" for label in names], col(ORDER))
        aligned = first if aligned is None else aligned.join(first, ID)
    return aligned


def _side(df, id_col, order_by, prefix, labels, rule) -> DataFrame:
    return df.select(
        rule.apply(col(resolve_column(df, id_col))).alias(ID),
        order_column(df, order_by).alias(ORDER),
        *prefix_columns(df, prefix, labels),
    )
