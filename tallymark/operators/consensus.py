"""Consensus labels over several runs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .columns import ID, binary, col

STRATEGIES = ("any_positive", "majority", "unanimity")


def vote_threshold(strategy: str, runs: int) -> int:
    """Votes a label needs under a strategy."""
    needed = {"any_positive": 1, "majority": runs // 2 + 1, "unanimity": runs}
    if strategy not in needed:
        raise ValueError(f"Unknown strategy {strategy!r}; use one of {STRATEGIES}.")
    return needed[strategy]


def consensus(
    aligned: DataFrame, runs: Sequence[str], labels: Sequence[str], strategy: str
) -> DataFrame:
    """VolumeName and a 0/1 column per label; a projection of the aligned runs."""
    needed = vote_threshold(strategy, len(runs))

    def decided(label: str) -> Column:
        ballots = [binary(aligned, f"{run}__{label}").cast("bigint") for run in runs]
        return (sum(ballots[1:], ballots[0]) >= needed).cast("int").alias(label)

    return aligned.select(col(ID), *[decided(label) for label in labels])


def consensus_summary(
    votes: DataFrame, runs: Sequence[str], strategies: Sequence[str] = STRATEGIES
) -> DataFrame:
    """Per strategy: threshold, rows and positive labels, from the vote counts alone."""
    if not strategies:
        raise ValueError("No strategies given.")
    total = sum((col(f"v{i}").cast("bigint") for i in range(len(runs))), F.lit(0).cast("bigint"))
    per_strategy = F.array(
        *[
            F.struct(
                F.lit(position).alias("strategy_pos"),
                F.lit(name).alias("strategy"),
                F.lit(vote_threshold(name, len(runs))).alias("threshold"),
            )
            for position, name in enumerate(strategies)
        ]
    )
    judged = votes.select("label_pos", "n", total.alias("total"), F.inline(per_strategy))
    counted = judged.groupBy("strategy_pos", "strategy", "threshold").agg(
        F.sum(F.when(col("label_pos") == 0, col("n")).otherwise(F.lit(0))).alias("num_rows"),
        F.sum(F.when(col("total") >= col("threshold"), col("n")).otherwise(F.lit(0))).alias(
            "num_positive_labels"
        ),
    )
    return counted.withColumn("num_sets", F.lit(len(runs)))
