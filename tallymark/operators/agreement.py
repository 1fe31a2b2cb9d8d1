"""Agreement between label runs, with no run taken as the truth.

The aligned runs are read once, into the vote counts; pairs, kappas and
all-run rates are then computed on that small table.
"""

from __future__ import annotations

import itertools
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.coercion import ratio, round4
from .columns import binary, col
from .metrics import MACRO
from .votes import confusion_cells, vote_counts


def run_votes(aligned: DataFrame, runs: Sequence[str], labels: Sequence[str]) -> DataFrame:
    """Vote counts of aligned runs: (label_pos, label, v0..vK, n)."""
    votes = [[binary(aligned, f"{run}__{label}") for run in runs] for label in labels]
    return vote_counts(aligned, labels, votes)


def agreement_columns(tp: Column, fp: Column, fn: Column, tn: Column) -> dict[str, Column]:
    """Raw agreement, Cohen's kappa and Matthews correlation of four counts.

    Everything runs in DOUBLE: the product under the MCC root overflows BIGINT
    at a few million rows.
    """
    a, b, c, d = (x.cast("double") for x in (tp, fp, fn, tn))
    n = a + b + c + d
    agreement = ratio(a + d, n)
    chance = ((a + c) / n) * ((a + b) / n) + ((d + b) / n) * ((d + c) / n)
    certain = F.when(agreement == 1.0, F.lit(1.0)).otherwise(F.lit(0.0))
    kappa = F.when(n == 0, F.lit(0.0)).otherwise(
        F.when(1 - chance == 0, certain).otherwise((agreement - chance) / (1 - chance))
    )
    spread = F.sqrt((a + b) * (a + c) * (d + b) * (d + c))
    mcc = F.when(spread > 0, (a * d - b * c) / spread).otherwise(F.lit(0.0))
    return {
        "agreement": round4(agreement),
        "cohen_kappa": round4(kappa),
        "mcc": round4(mcc),
        "n": tp + fp + fn + tn,
    }


def pairwise_agreement(votes: DataFrame, runs: Sequence[str]) -> DataFrame:
    """One row per unordered pair of runs and label; the first run plays truth."""
    pairs = list(itertools.combinations(range(len(runs)), 2))
    sides = F.array(
        *[
            F.struct(
                F.lit(position).alias("pair_pos"),
                F.lit(f"{runs[i]} vs {runs[j]}").alias("pair"),
                col(f"v{i}").alias("a"),
                col(f"v{j}").alias("b"),
            )
            for position, (i, j) in enumerate(pairs)
        ]
    )
    paired = votes.select("label_pos", "label", "n", F.inline(sides))
    counts = paired.groupBy("pair_pos", "pair", "label_pos", "label").agg(
        *confusion_cells(col("a"), col("b"), col("n"))
    )
    scores = agreement_columns(*[col(c) for c in ("tp", "fp", "fn", "tn")])
    return counts.select(
        "pair_pos",
        "pair",
        "label_pos",
        "label",
        *[value.alias(name) for name, value in scores.items()],
        "tp",
        "fp",
        "fn",
        "tn",
    )


def pairwise_summary(pairwise: DataFrame) -> DataFrame:
    """Macro row per pair: means of the rounded scores, n of the first label."""
    return pairwise.groupBy("pair_pos", "pair").agg(
        F.lit(MACRO).alias("label"),
        *[round4(F.avg(name)).alias(name) for name in ("agreement", "cohen_kappa", "mcc")],
        F.min_by("n", "label_pos").alias("n"),
        *[F.sum(name).alias(name) for name in ("tp", "fp", "fn", "tn")],
    )


def all_sets_agreement(votes: DataFrame, runs: Sequence[str]) -> DataFrame:
    """Per label: share of rows all runs agree on, all-positive and all-negative counts."""
    ballots = [col(f"v{i}") for i in range(len(runs))]
    equal = F.lit(True)
    for ballot in ballots[1:]:
        equal = equal & (ballot == ballots[0])
    total = sum((b.cast("bigint") for b in ballots), F.lit(0).cast("bigint"))

    def weigh(condition: Column) -> Column:
        return F.sum(F.when(condition, col("n")).otherwise(F.lit(0)))

    return votes.groupBy("label_pos", "label").agg(
        round4(ratio(weigh(equal), F.sum("n"))).alias("all_sets_agreement"),
        weigh(total == len(runs)).alias("all_positive_consensus"),
        weigh(total == 0).alias("all_negative_consensus"),
        F.sum("n").alias("n"),
    )


def agreement_summary(votes: DataFrame, runs: Sequence[str], labels: Sequence[str]) -> DataFrame:
    """One-row summary of an agreement run."""
    per_label = all_sets_agreement(votes, runs)
    return per_label.agg(
        F.lit(len(runs)).alias("num_sets"),
        F.array(*[F.lit(r) for r in runs]).alias("set_names"),
        F.coalesce(F.max("n"), F.lit(0)).cast("bigint").alias("total_reports_matched"),
        F.array(*[F.lit(x) for x in labels]).alias("labels_compared"),
        F.lit(len(runs) * (len(runs) - 1) // 2).alias("num_pairs"),
        F.coalesce(round4(F.avg("all_sets_agreement")), F.lit(0.0)).alias(
            "overall_all_sets_agreement"
        ),
    )
