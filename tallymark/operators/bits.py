"""Agreement of many label runs from bit slices: 64 rows of a run are one number.

Vote patterns of N runs may be as many as rows once N is large. Here each run
and label has a word per 64 rows for its positive votes and one for its negative
ones, and all counts are sums of set bits of words and of ANDs of two words.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.coercion import ratio, round4
from .agreement import agreement_columns
from .columns import binary

WORD = 64


def bit_votes(aligned: DataFrame, runs: Sequence[str], labels: Sequence[str]) -> DataFrame:
    """Rows (word, label_pos, label, ones, zeros): arrays with a word of 64 rows for every run.

    Rows of one word lie next to each other in a task, so they become one row
    before the shuffle. Votes other than 0 and 1 are in neither array.
    """
    number = F.monotonically_increasing_id()
    votes = [F.array(*[binary(aligned, f"{run}__{label}") for run in runs]) for label in labels]
    sliced = F.array(
        *[F.struct(F.lit(i).alias("label_pos"), F.lit(label).alias("label"), v.alias("votes")) for i, (label, v) in enumerate(zip(labels, votes))]
    )
    rows = aligned.select(
        F.shiftright(number, 6).alias("word"), F.expr("shiftleft(1L, cast(monotonically_increasing_id() & 63 as int))").alias("bit"), F.inline(sliced)
    )

    def sliced_word(run: int, vote: int) -> Column:
        held = F.get("votes", F.lit(run)) == vote
        return F.bit_or(F.when(held, F.col("bit")).otherwise(F.lit(0).cast("bigint")))

    return rows.groupBy("word", "label_pos", "label").agg(
        F.array(*[sliced_word(i, 1) for i in range(len(runs))]).alias("ones"),
        F.array(*[sliced_word(i, 0) for i in range(len(runs))]).alias("zeros"),
    )


def pairwise_agreement_bits(words: DataFrame, runs: Sequence[str]) -> DataFrame:
    """``pairwise_agreement`` of the runs of ``bit_votes``: each pair's cells are set bits of two words' AND."""
    names = F.array(*[F.lit(run) for run in runs])
    first = words.select("label_pos", "label", "ones", "zeros", F.posexplode("ones").alias("i", "one"))
    first = first.withColumn("zero", F.get("zeros", F.col("i")))
    rest = F.arrays_zip("ones", "zeros")
    pairs = first.select("label_pos", "label", "i", "one", "zero", F.posexplode(F.slice(rest, F.col("i") + 2, len(runs))).alias("step", "other"))

    def bits(left: str, right: str) -> Column:
        return F.sum(F.bit_count(F.col(left).bitwiseAND(F.col(f"other.{right}"))).cast("bigint"))

    counts = pairs.groupBy("i", (F.col("i") + F.col("step") + 1).alias("j"), "label_pos", "label").agg(
        bits("one", "ones").alias("tp"), bits("zero", "ones").alias("fp"), bits("one", "zeros").alias("fn"), bits("zero", "zeros").alias("tn")
    )
    scores = agreement_columns(*[F.col(c) for c in ("tp", "fp", "fn", "tn")])
    many, i, j = len(runs), F.col("i"), F.col("j")
    position = (i * (2 * many - i - 1) / 2).cast("int") + j - i - 1
    pair = F.concat(F.get(names, i), F.lit(" vs "), F.get(names, j))
    return counts.select(
        position.alias("pair_pos"), pair.alias("pair"), "label_pos", "label",
        *[value.alias(name) for name, value in scores.items()], "tp", "fp", "fn", "tn",
    )


def all_sets_agreement_bits(words: DataFrame, runs: Sequence[str], rows: int) -> DataFrame:
    """``all_sets_agreement`` of ``bit_votes`` over ``rows`` rows; votes other than 0 and 1 agree with none."""

    def common(name: str) -> Column:
        everyone = F.aggregate(name, F.lit(-1).cast("bigint"), lambda a, b: a.bitwiseAND(b))
        return F.sum(F.bit_count(everyone).cast("bigint"))

    counts = words.groupBy("label_pos", "label").agg(common("ones").alias("all_positive_consensus"), common("zeros").alias("all_negative_consensus"))
    equal = F.col("all_positive_consensus") + F.col("all_negative_consensus")
    return counts.select(
        "label_pos", "label", round4(ratio(equal, F.lit(rows))).alias("all_sets_agreement"),
        "all_positive_consensus", "all_negative_consensus", F.lit(rows).cast("bigint").alias("n"),
    )
