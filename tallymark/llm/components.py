"""Connected components of links, by rounds of joins."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def merge(labels: np.ndarray, left: np.ndarray, right: np.ndarray) -> None:
    """Add links between positions to ``labels``, where each position has its group's first."""
    while len(left):
        a, b = labels[left], labels[right]
        apart = a != b
        if not apart.any():
            return
        left, right, a, b = left[apart], right[apart], a[apart], b[apart]
        np.minimum.at(labels, np.maximum(a, b), np.minimum(a, b))
        while True:
            jumped = labels[labels]
            if (jumped == labels).all():
                break
            labels[:] = jumped


def connect(links: DataFrame) -> DataFrame:
    """(``node``, ``component``) for every node of ``links`` (``a``, ``b``: long) but the components' own.

    Alternates two joins until nothing changes: every node points its larger
    neighbours to the smallest node it knows, then its smaller ones. The number
    of links never grows, a node with many links is combined before the shuffle,
    and nothing but two sums reaches the driver. Chains need a number of rounds
    that grows with the logarithm of their length.
    """
    low, high = F.least("a", "b"), F.greatest("a", "b")
    state = cut(links.where("a != b").select(high.alias("a"), low.alias("b")).distinct())
    before = None
    while True:
        mark = state.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if mark[0] == 0 or mark == before:
            return state.select(F.col("a").alias("node"), F.col("b").alias("component"))
        before = mark
        both = state.union(state.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        state = cut(small.union(least).distinct())
