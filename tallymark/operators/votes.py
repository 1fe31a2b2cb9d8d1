"""Vote patterns: the small table every count-based metric is derived from."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .columns import col


def vote_counts(
    df: DataFrame, labels: Sequence[str], votes: Sequence[Sequence[Column]], weight: Column | None = None
) -> DataFrame:
    """Rows (label_pos, label, v0..vK, n): how often each vote pattern occurs.

    ``votes[i]`` holds the INT votes on ``labels[i]``. Counting happens before
    the shuffle, which then carries patterns, not rows.
    """
    width = len(votes[0])
    flat = [v.alias(f"_l{i}_{j}") for i, per_label in enumerate(votes) for j, v in enumerate(per_label)]
    weight = F.lit(1).cast("bigint") if weight is None else weight
    rows = df.select(*flat, weight.alias("_n"))
    per_label = F.array(
        *[
            F.struct(
                F.lit(i).alias("label_pos"),
                F.lit(label).alias("label"),
                *[col(f"_l{i}_{j}").alias(f"v{j}") for j in range(width)],
            )
            for i, label in enumerate(labels)
        ]
    )
    long = rows.select("_n", F.inline(per_label))
    keys = ["label_pos", "label", *[f"v{j}" for j in range(width)]]
    return long.groupBy(*keys).agg(F.sum("_n").alias("n"))


def confusion_cells(truth: Column, pred: Column, n: Column) -> list[Column]:
    """tp, fp, fn, tn as weighted sums. Votes other than 0 and 1 enter no cell."""

    def cell(t: int, p: int) -> Column:
        return F.sum(F.when((truth == t) & (pred == p), n).otherwise(F.lit(0)))

    return [
        cell(1, 1).alias("tp"),
        cell(0, 1).alias("fp"),
        cell(1, 0).alias("fn"),
        cell(0, 0).alias("tn"),
    ]
