"""Score one label table against another."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from ..functions.identifiers import IdRule
from ..operators.align import align_pair, pair_labels, pair_table, unmatched_ids
from ..operators.columns import DEFAULT_EXCLUDE, ID
from ..operators.metrics import (
    binary_metrics,
    compare_summary,
    confusion_counts,
    discrepancies,
    pair_patterns,
    with_averages,
)
from ..durable import materialise
from .results import Comparison


def compare_runs(
    left: DataFrame,
    right: DataFrame,
    labels: Sequence[str] | None = None,
    *,
    left_name: str = "left",
    right_name: str = "right",
    left_id: str = ID,
    right_id: str = ID,
    rule: IdRule = IdRule(),
    exclude: Sequence[str] = DEFAULT_EXCLUDE,
    left_order: str | None = None,
    right_order: str | None = None,
) -> Comparison:
    """Metrics, discrepancies and summary, the left table being the truth.

    The tables are aligned once, into a checkpoint of IDs and labels that the
    metrics, the summary and the discrepancies are read from.
    """
    names = pair_labels(left, right, labels, exclude)
    sides = {"left_id": left_id, "right_id": right_id, "rule": rule}
    missing = None
    if rule.keep_reconstruction_suffix:
        table = align_pair(left, right, names, **sides)
        missing = unmatched_ids(left, right, **sides)
    else:
        table = pair_table(left, right, names, left_order=left_order, right_order=right_order, **sides)
    table = materialise(table)
    patterns = pair_patterns(table, names)
    metrics = with_averages(binary_metrics(confusion_counts(patterns, names)))
    summary = compare_summary(patterns, names, left_name, right_name, missing)
    return Comparison(metrics, discrepancies(table, names), summary)
