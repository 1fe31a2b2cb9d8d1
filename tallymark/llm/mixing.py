"""Mixing: temperature weights of sources, realised as budgeted block permutations."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, spread

#: Bisections, and how many of them one pass over the sources does.
HALVINGS, HALVINGS_A_PASS = 40, 5
#: A source's permutation is summed in this many stretches before any row is ranked.
STRETCHES = 65_536
KEY_BITS = 60
#: Up to this many sources their plan (a few numbers each) is broadcast; beyond, joined.
BROADCAST_SOURCES = 100_000


@dataclass(frozen=True)
class Mixture:
    """``plan`` has a row per source; ``sizes`` the id, source and tokens of every document."""

    plan: DataFrame
    sizes: DataFrame
    exponent: float
    seed: int

    def draws(self, rows: DataFrame, doc_id: Column, source: Column) -> DataFrame:
        """``rows`` with ``block``, ``weight`` and ``place``, once for every time a document is drawn.

        Sorted by ``place`` (0 to 1) the draws of all sources are spread evenly,
        and within a source block follows block, each in an order of its own.
        """
        keyed = rows.select(F.struct(*[F.col(f"`{c}`") for c in rows.columns]).alias("row"), doc_id.alias("id"), source.alias("source"))
        plan = self.plan.select(F.col("source").alias("of"), "weight", "passes", "whole", "bound")
        if self.plan.count() <= BROADCAST_SOURCES:
            plan = F.broadcast(plan)
        met = keyed.join(plan, F.col("source").eqNullSafe(F.col("of")))
        last = F.when(order_key(F.col("id"), F.col("whole"), self.seed) < F.col("bound"), 1).otherwise(0)
        times = (F.col("whole") + last).cast("int")
        drawn = met.where(times > 0).withColumn("block", F.explode(F.sequence(F.lit(0), times - 1)))
        along = order_key(F.col("id"), F.col("block"), self.seed) / F.lit(float(1 << KEY_BITS))
        # The last block can end a little beyond its part of the keys.
        place = F.least(F.lit(1.0), (F.col("block") + along) / F.col("passes"))
        return drawn.select("row", "block", "weight", place.alias("place"))


def order_key(doc_id: Column, block: Column, seed: int) -> Column:
    """Place of a document in its source's permutation of one block."""
    return spread(F.coalesce(doc_id.cast("string"), F.lit("null")), block, F.lit(seed))


def count_tokens(text: Column) -> Column:
    """Words of a text and its end."""
    return (F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")) + F.lit(1)).cast("long")


def bisect_exponent(shares: DataFrame, fits: Callable[[float, float, float, float, float], bool]) -> float:
    """Smallest exponent in (0, 1] that fits, to 2^-40; 0 if it fits.

    ``fits(exponent, sum of share^exponent, entropy, smallest, largest share)``
    must hold from some exponent on. One aggregate over the sources evaluates 31
    exponents, so each pass is five bisections; only sums reach the driver.
    """
    low, high = 0.0, 1.0
    for step in range(HALVINGS // HALVINGS_A_PASS):
        points = 1 << HALVINGS_A_PASS
        tried = [low + (high - low) * i / points for i in range(0 if step == 0 else 1, points)]
        sums = shares.agg(
            F.min("share").alias("least"),
            F.max("share").alias("most"),
            *[F.sum(F.pow("share", F.lit(a))).alias(f"z{i}") for i, a in enumerate(tried)],
            *[F.sum(F.pow("share", F.lit(a)) * F.log("share")).alias(f"l{i}") for i, a in enumerate(tried)],
        ).first()
        good = []
        for i, a in enumerate(tried):
            z = sums[f"z{i}"]
            good.append(fits(a, z, math.log(z) - a * sums[f"l{i}"] / z, sums["least"], sums["most"]))
        if step == 0 and good[0]:
            return 0.0
        first = next((i for i, ok in enumerate(good) if ok), None)
        width = (high - low) / points
        if first is None:
            low = high - width
        else:
            low, high = tried[first] - width, tried[first]
    return high


def plan_mixture(
    docs: DataFrame,
    max_repeats: float | None = 2.0,
    target_entropy: float | None = None,
    budget: int | None = None,
    seed: int = 42,
    id_col: str = "doc_id",
    source_col: str = "source",
    text_col: str = "text",
) -> Mixture:
    """Weights and draws that bring every source's share of tokens to its target.

    Target weights are the token shares to the power of an exponent between 0
    (all sources alike) and 1 (as they are). The exponent is bisected: the
    smallest with which no source is passed more than ``max_repeats`` times, or,
    if ``target_entropy`` is given, the smallest with which the entropy of the
    weights is at most that part of its maximum. ``budget`` is the number of
    tokens to draw; by default it is the smallest with which every document is
    drawn at least once, so nothing is left out.

    A source's budget is drawn in blocks: each is a permutation of all its
    documents, and of the last one only as many documents as fit. Where that one
    ends is found from sums over stretches of the permutation, then ranking the
    documents of one stretch, so a source with most of the corpus is never
    gathered.

    Tokens are words plus one, so empty and null texts count 1. Null sources are
    one source of their own, null ids share a place in each permutation (they are
    drawn or left together, like repeated rows). An empty table gives an empty
    plan with exponent 1.
    """
    if (max_repeats is None) == (target_entropy is None):
        raise ValueError("Give one of max_repeats and target_entropy.")
    if max_repeats is not None and max_repeats < 1 and budget is None:
        raise ValueError("max_repeats must be at least 1.")
    sizes = cut(
        docs.select(
            F.col(f"`{id_col}`").alias("id"),
            F.col(f"`{source_col}`").alias("source"),
            count_tokens(F.col(f"`{text_col}`")).alias("tokens"),
        )
    )
    totals = cut(sizes.groupBy("source").agg(F.sum("tokens").alias("tokens")))
    overall = totals.agg(F.sum("tokens").alias("tokens"), F.count("*").alias("sources")).first()
    corpus, sources = overall["tokens"] or 0, overall["sources"]
    shares = totals.withColumn("share", F.col("tokens") / F.lit(float(max(1, corpus))))

    def fits(exponent: float, z: float, entropy: float, least: float, most: float) -> bool:
        if target_entropy is not None:
            return entropy <= target_entropy * math.log(max(2, sources))
        if budget is None:
            return (least / most) ** (exponent - 1.0) <= max_repeats
        return budget * least ** (exponent - 1.0) / z <= max_repeats * corpus

    exponent = bisect_exponent(shares, fits) if sources else 1.0
    known = shares.agg(F.max("share").alias("most"), F.sum(F.pow("share", F.lit(exponent))).alias("z")).first()
    z, most = known["z"] or 1.0, known["most"] or 1.0
    weight = F.pow("share", F.lit(exponent)) / F.lit(z)
    if budget is None:  # exactly 1 for the largest source
        passes = F.pow(F.col("share") / F.lit(most), F.lit(exponent - 1.0))
    else:
        passes = F.lit(float(budget)) * weight / F.col("tokens")
    amounts = shares.select("source", "tokens", weight.alias("weight"), passes.alias("passes"))
    amounts = amounts.withColumn("budget", F.floor(F.col("passes") * F.col("tokens") + 0.5).cast("long"))
    amounts = amounts.withColumn("whole", F.floor(F.col("budget") / F.col("tokens")).cast("long"))
    amounts = cut(amounts.withColumn("left", F.col("budget") - F.col("whole") * F.col("tokens")))

    few = amounts.select(F.col("source").alias("of"), "whole", "left")
    if sources <= BROADCAST_SOURCES:
        few = F.broadcast(few)
    keyed = sizes.join(few, F.col("source").eqNullSafe(F.col("of")))
    key = order_key(F.col("id"), F.col("whole"), seed)
    keyed = keyed.select("source", "left", "tokens", key.alias("key"))
    keyed = keyed.withColumn("stretch", F.shiftright("key", KEY_BITS - int(math.log2(STRETCHES))).cast("int"))
    sums = keyed.groupBy("source", "stretch").agg(F.sum("tokens").alias("tokens"), F.max("left").alias("left"))
    upto = Window.partitionBy("source").orderBy("stretch")
    ends = sums.withColumn("upto", F.sum("tokens").over(upto))
    ends = ends.where((F.col("upto") > F.col("left")) & (F.col("upto") - F.col("tokens") <= F.col("left")))
    ends = ends.select(F.col("source").alias("of"), F.col("stretch").alias("at"), (F.col("upto") - F.col("tokens")).alias("before"))
    inside = keyed.join(ends, F.col("source").eqNullSafe(F.col("of")) & (F.col("stretch") == F.col("at")))
    running = F.col("before") + F.sum("tokens").over(Window.partitionBy("source").orderBy("key"))
    beyond = inside.withColumn("running", running).where(F.col("running") > F.col("left"))
    bounds = beyond.groupBy("source").agg(F.min("key").alias("bound")).withColumnRenamed("source", "of")
    plan = amounts.join(bounds, F.col("source").eqNullSafe(F.col("of")), "left").drop("of", "left")
    return Mixture(cut(plan.withColumn("bound", F.coalesce("bound", F.lit(0)))), sizes, exponent, seed)


def mix(docs: DataFrame, max_repeats: float | None = 2.0, target_entropy: float | None = None, budget: int | None = None, seed: int = 42) -> DataFrame:
    """Documents as often as the mixture draws them, all columns as given."""
    mixture = plan_mixture(docs, max_repeats, target_entropy, budget, seed)
    return mixture.draws(docs, F.col("doc_id"), F.col("source")).select("row.*")
