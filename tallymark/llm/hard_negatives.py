"""Hard negatives: Strassen products of integer tiles, and best lists that merge."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, finite

#: Anchors and candidates of a tile; with a vector's length they bound what a task holds.
ANCHORS, CANDIDATES = 1024, 4096
#: No further halving below this length of a side.
LEAF = 32
#: Below this squared length of all rows, every product and window bound fits into 64 bits.
LARGEST = float(2**61)


def strassen(left: np.ndarray, right: np.ndarray, leaf: int = LEAF) -> np.ndarray:
    """Product of two int64 matrices, by seven products of halves instead of eight.

    Sides of odd length get a row or column of zeros. Sums of int64 wrap around,
    which is exact arithmetic modulo 2^64, so the result is exact wherever the
    true product fits into 64 bits, whatever the sums between are.
    """
    rows, inner, columns = left.shape[0], left.shape[1], right.shape[1]
    if min(rows, inner, columns) <= leaf:
        return left @ right
    even = [side + side % 2 for side in (rows, inner, columns)]
    a, b = _padded(left, even[0], even[1]), _padded(right, even[1], even[2])
    m, k, n = (side // 2 for side in even)
    a11, a12, a21, a22 = a[:m, :k], a[:m, k:], a[m:, :k], a[m:, k:]
    b11, b12, b21, b22 = b[:k, :n], b[:k, n:], b[k:, :n], b[k:, n:]
    p1 = strassen(a11 + a22, b11 + b22, leaf)
    p2 = strassen(a21 + a22, b11, leaf)
    p3 = strassen(a11, b12 - b22, leaf)
    p4 = strassen(a22, b21 - b11, leaf)
    p5 = strassen(a11 + a12, b22, leaf)
    p6 = strassen(a21 - a11, b11 + b12, leaf)
    p7 = strassen(a12 - a22, b21 + b22, leaf)
    out = np.empty((2 * m, 2 * n), np.int64)
    out[:m, :n] = p1 + p4 - p5 + p7
    out[:m, n:] = p3 + p5
    out[m:, :n] = p2 + p4
    out[m:, n:] = p1 - p2 + p3 + p6
    return out[:rows, :columns]


def _padded(matrix: np.ndarray, rows: int, columns: int) -> np.ndarray:
    if matrix.shape == (rows, columns):
        return matrix
    out = np.zeros((rows, columns), np.int64)
    out[: matrix.shape[0], : matrix.shape[1]] = matrix
    return out


def best(scores: np.ndarray, most: int) -> np.ndarray:
    """Positions of the ``most`` largest scores, falling; of equal ones the first."""
    if len(scores) > most:
        floor = np.partition(scores, len(scores) - most)[len(scores) - most]
        above, at = np.flatnonzero(scores > floor), np.flatnonzero(scores == floor)
        near = np.sort(np.concatenate([above, at[: most - len(above)]]))
    else:
        near = np.arange(len(scores))
    return near[np.argsort(-scores[near], kind="stable")]


def in_tiles(
    anchors: DataFrame, candidates: DataFrame, keys: list[str], work: Callable[[pd.DataFrame, pd.DataFrame, np.ndarray], pd.DataFrame], schema: str
) -> DataFrame:
    """``work`` on every tile of anchors and candidates with equal ``keys``, with its scores.

    Both sides of a key are dealt to parts by hash, and a row goes to each part of
    the other side, so a tile has the same size however frequent its key is.
    Candidates come in the order of their ids.
    """

    def parts(rows: DataFrame, size: int, name: str) -> DataFrame:
        return rows.groupBy(*keys).agg(F.ceil(F.count("*") / size).cast("int").alias(name))

    both = parts(anchors, ANCHORS, "of_a").join(parts(candidates, CANDIDATES, "of_c"), keys)

    def dealt(rows: DataFrame, own: str, other: str) -> DataFrame:
        rows = rows.join(both, keys).withColumn(own, F.pmod(F.xxhash64("row"), F.col(f"of_{own}")).cast("int"))
        rows = rows.withColumn(other, F.explode(F.sequence(F.lit(0), F.col(f"of_{other}") - 1)))
        named = [F.col(c).alias(c) for c in rows.columns if c not in ("of_a", "of_c")]  # the sides share no column
        return rows.select(*named).groupBy(*keys, "a", "c")

    def tile(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return work(left.iloc[:0], right.iloc[:0], np.zeros((0, 0), np.int64))
        right = right.sort_values(["id", "row"], ignore_index=True)
        a, b = (np.stack(side["x"].to_numpy()).astype(np.int64) for side in (left, right))
        return work(left, right, strassen(a, b.T))

    return dealt(anchors, "a", "c").cogroup(dealt(candidates, "c", "a")).applyInPandas(tile, schema)


def merged(lists: DataFrame, of: list[str], most: int) -> DataFrame:
    """The best ``most`` of all tiles' lists with equal ``of``, with their ``rank``; tasks cut their own first."""
    order = Window.partitionBy(*of).orderBy(F.desc("score"), "id", "row")
    return lists.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)


def hard_negatives(
    vectors: DataFrame,
    anchor: Column,
    positives: int = 5,
    negatives: int = 5,
    low: int = 80,
    high: int = 100,
    scale: int = 256,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
) -> DataFrame:
    """Rows of other labels that score almost as high as an anchor's best rows of its own.

    Components are floored to integers after multiplying by ``scale``; a score is
    the integer inner product with the anchor, by Strassen products of tiles.
    An anchor's positives are its first ``positives`` other rows of equal label,
    by falling score, then id. For each, the first ``negatives`` rows of other
    labels with a score from ``low`` to ``high`` percent of the positive's are
    returned. Every tile keeps a list of that length per anchor, or per anchor and
    positive, and lists of tiles merge into one.

    ``anchor`` is a condition on the given rows. Returns ``anchor_id``, ``positive_id``,
    ``rank`` (from 1), ``negative_id``, ``positive_score``, ``negative_score``.

    Rows with a null id or label, or a vector that is null, empty, or holds null or
    non-finite components take no part, nor do those whose squared length in
    integers reaches 2^61: only below that do all scores fit into 64 bits. Vectors
    of different lengths have no product and do not meet. A row is another row
    if it is not the same one, also where ids or whole rows repeat. A positive of
    negative score has an empty window. An empty table gives an empty result.
    """
    vector = F.col(f"`{vector_col}`")
    scaled = F.transform(vector.cast("array<double>"), lambda c: c * scale)
    rows = vectors.select(
        F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{label_col}`").alias("label"),
        F.coalesce(anchor, F.lit(False)).alias("is_anchor"), scaled.alias("x"),
    ).where(F.col("id").isNotNull() & F.col("label").isNotNull() & finite(F.col("x")))
    square = F.aggregate("x", F.lit(0.0), lambda total, c: total + c * c)
    rows = rows.where(square < LARGEST).withColumn("x", F.transform("x", lambda c: F.floor(c).cast("int")))
    # Numbered once, so that a row stays the same row in every branch.
    rows = cut(rows.select("*", F.size("x").alias("width"), F.monotonically_increasing_id().alias("row")))
    anchors, candidates = rows.where("is_anchor").drop("is_anchor"), rows.drop("is_anchor")

    def same_label(left: pd.DataFrame, right: pd.DataFrame, scores: np.ndarray) -> pd.DataFrame:
        found = []
        ids, numbers = right["id"].to_numpy(np.int64), right["row"].to_numpy(np.int64)
        for at, own in enumerate(left["row"].to_numpy(np.int64)):
            line, others = scores[at], np.flatnonzero(numbers != own)
            near = others[best(line[others], positives)]
            found.append((np.full(len(near), own), ids[near], numbers[near], line[near]))
        return _frame(found, ["anchor", "id", "row", "score"])

    lists = in_tiles(anchors, candidates, ["label", "width"], same_label, "anchor long, id long, row long, score long")
    chosen = merged(lists, ["anchor"], positives).groupBy("anchor").agg(
        F.array_sort(F.collect_list(F.struct("rank", "id", "score"))).alias("positives")
    )
    chosen = chosen.select("anchor", F.col("positives.id").alias("positive_ids"), F.col("positives.score").alias("positive_scores"))
    asked = cut(anchors.join(chosen, anchors["row"] == chosen["anchor"]).drop("anchor"))

    def in_windows(left: pd.DataFrame, right: pd.DataFrame, scores: np.ndarray) -> pd.DataFrame:
        found = []
        ids, numbers, labels = right["id"].to_numpy(np.int64), right["row"].to_numpy(np.int64), right["label"].to_numpy()
        lowest = left["positive_scores"].map(min) if len(left) else []
        for at, (own, label, targets, least) in enumerate(zip(left["row"], left["label"], left["positive_scores"], lowest)):
            line = scores[at]
            # Python integers do not overflow; a score in the window is a score between two whole bounds.
            floor = -(-low * int(least) // 100)
            others = np.flatnonzero((labels != label) & (line >= max(min(floor, 2**63 - 1), -(2**63))))
            line = line[others]
            for number, target in enumerate(targets.tolist()):
                start, stop = -(-low * target // 100), high * target // 100
                if start > stop:
                    continue
                inside = np.flatnonzero((line >= start) & (line <= stop))
                near = others[inside[best(line[inside], negatives)]]
                found.append((np.full(len(near), own), np.full(len(near), number), ids[near], numbers[near], scores[at][near]))
        return _frame(found, ["anchor", "number", "id", "row", "score"])

    lists = in_tiles(asked, candidates, ["width"], in_windows, "anchor long, number int, id long, row long, score long")
    mined = merged(lists, ["anchor", "number"], negatives)
    named = asked.select(F.col("row").alias("anchor"), F.col("id").alias("anchor_id"), "positive_ids", "positive_scores")
    return mined.join(named, "anchor").select(
        "anchor_id",
        F.get("positive_ids", F.col("number")).alias("positive_id"),
        "rank",
        F.col("id").alias("negative_id"),
        F.get("positive_scores", F.col("number")).alias("positive_score"),
        F.col("score").alias("negative_score"),
    )


def _frame(found: list[tuple], names: list[str]) -> pd.DataFrame:
    if not found:
        return pd.DataFrame({name: np.zeros(0, np.int64) for name in names})
    return pd.DataFrame(dict(zip(names, map(np.concatenate, zip(*found)))))
