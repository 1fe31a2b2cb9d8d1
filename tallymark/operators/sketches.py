"""Sketches of runs that are stored per part and merged later, instead of reading the runs again."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.identifiers import IdRule
from .columns import ID, col, resolve_column

#: IDs a sketch holds exactly, as a power of two; beyond, its error is about 1 / sqrt of that.
LOG_IDS = 16
#: Size of a quantile sketch: ranks are off by about 1.7 / K of the rows, and exact up to K rows.
K = 4096


def id_sketches(df: DataFrame, by: Sequence[str] = (), *, id_col: str = ID, rule: IdRule = IdRule(), log_ids: int = LOG_IDS) -> DataFrame:
    """Theta sketch ``ids`` of the normalised IDs, and ``rows``, for every group of ``by``.

    A sketch is some hundred kilobytes at most, whatever the rows. Null IDs count as in ``align_pair``.
    """
    named = df.select(*[col(c) for c in by], rule.apply(col(resolve_column(df, id_col))).alias("_id"))
    return named.groupBy(*by).agg(F.theta_sketch_agg("_id", log_ids).alias("ids"), F.count("*").alias("rows"))


def merge_ids(parts: DataFrame, by: Sequence[str] = (), *, log_ids: int = LOG_IDS) -> DataFrame:
    """Sketches of parts merged into one for every group of ``by``."""
    return parts.groupBy(*by).agg(F.theta_union_agg("ids", log_ids).alias("ids"), F.sum("rows").alias("rows"))


def overlap(left: DataFrame, right: DataFrame, *, log_ids: int = LOG_IDS) -> DataFrame:
    """One row: how many IDs both sides have, and only one, from two tables of sketches.

    ``error`` is the standard error of each count, in IDs; 0 while no sketch is full,
    as counts are then exact.
    """
    sides = merge_ids(left, log_ids=log_ids).select(F.col("ids").alias("a")).crossJoin(
        merge_ids(right, log_ids=log_ids).select(F.col("ids").alias("b"))
    )  # one row each
    estimate, room = F.theta_sketch_estimate, float(2**log_ids)
    both = estimate(F.theta_union("a", "b", F.lit(log_ids)))
    counts = sides.select(
        estimate(F.theta_intersection("a", "b")).alias("matched"),
        estimate(F.theta_difference("a", "b")).alias("left_only"),
        estimate(F.theta_difference("b", "a")).alias("right_only"),
        both.alias("ids"),
    )
    return counts.withColumn("error", F.when(F.col("ids") < room, 0.0).otherwise(F.col("ids") / room**0.5))


def value_sketches(df: DataFrame, value: str, by: Sequence[str] = (), k: int = K) -> DataFrame:
    """Quantile sketch ``sketch`` of the non-null numbers of a column for every group of ``by``."""
    named = df.select(*[col(c) for c in by], col(value).cast("double").alias("_value"))
    return named.where("_value is not null and not isnan(_value)").groupBy(*by).agg(F.kll_sketch_agg_double("_value", k).alias("sketch"))


def quantiles(parts: DataFrame, ranks: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """``n`` and ``q<rank>`` of merged quantile sketches: the smallest value with that share of rows at or below it."""
    merged = parts.groupBy(*by).agg(F.kll_merge_agg_double("sketch").alias("sketch"))
    names = [f"q{rank:g}" for rank in ranks]
    found = [F.kll_sketch_get_quantile_double("sketch", F.lit(float(rank))).alias(name) for rank, name in zip(ranks, names)]
    return merged.select(*[col(c) for c in by], F.kll_sketch_get_n_double("sketch").alias("n"), *found)
