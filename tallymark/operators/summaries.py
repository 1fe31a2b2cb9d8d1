"""Summaries over metric and discrepancy tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.coercion import round4
from .columns import binary, col, require_columns

# The columns averaged over metric files.
METRIC_COLUMNS = ("precision", "recall", "f1", "accuracy", "tp", "fp", "fn", "tn")


def classify_error(predicted: Column, actual: Column) -> Column:
    return (
        F.when((predicted == 1) & (actual == 0), F.lit("false_positive"))
        .when((predicted == 0) & (actual == 1), F.lit("false_negative"))
        .otherwise(F.lit("other"))
    )


def discrepancy_summary(discrepancies: DataFrame) -> DataFrame:
    """Errors by label and kind, most frequent first, labels ascending."""
    require_columns(discrepancies, ["Label", "Predicted", "Actual"])
    kind = classify_error(binary(discrepancies, "Predicted"), binary(discrepancies, "Actual"))
    counted = discrepancies.groupBy(col("Label"), kind.alias("error_type")).agg(
        F.count("*").alias("count")
    )
    return counted.orderBy(F.desc("count"), F.asc_nulls_last("Label"), F.asc("error_type"))


def discrepancy_totals(summary: DataFrame) -> DataFrame:
    """Total errors by label, most frequent first."""
    totals = summary.groupBy("Label").agg(F.sum("count").alias("total_errors"))
    return totals.orderBy(F.desc("total_errors"), F.asc_nulls_last("Label"))


def top_rows(ordered: DataFrame, top: int | None) -> DataFrame:
    """The first ``top`` rows of an ordered summary; None or 0 keeps them all."""
    return ordered.limit(top) if top is not None and top > 0 else ordered


def metrics_mean_std(metrics: DataFrame) -> DataFrame:
    """Mean and population standard deviation per label over metric tables."""
    require_columns(metrics, [*METRIC_COLUMNS, "label"])
    values = {name: col(name).cast("double") for name in METRIC_COLUMNS}
    return metrics.groupBy("label").agg(
        *[round4(F.avg(value)).alias(f"{name}_mean") for name, value in values.items()],
        *[round4(F.stddev_pop(value)).alias(f"{name}_std") for name, value in values.items()],
    )
