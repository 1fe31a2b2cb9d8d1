"""Embedding near-dedup: spherical-cap filters from product codes, joined and verified."""

from __future__ import annotations

from collections.abc import Iterator
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ann import usable
from .common import blocks, cut, in_runs, whole_ids
from .components import connect, merge

#: Independent codes, parts of a vector.
CODES, PARTS = 6, 2
#: Codewords of a part for 50,000 vectors; their number grows with the root of the
#: vectors, the filters so with the vectors, and a filter's share of them stays.
WORDS, FEWEST_WORDS = 256, 64
#: Filters of a vector, about; and of each code at least, by a lower bound where
#: the vector needs one.
FILTERS, LEAST = 50, 3
#: Vectors of a filter that are compared at once, and vectors decoded at once.
BLOCK, BATCH = 2_048, 512
#: Filters with more vectors than this are compared by matrix products, so many filters at once.
SMALL, COLUMNS = 32, 2_048
#: With fewer dimensions the caps of a code leave gaps, or tie by the hundred; filters are then boxes of
#: the first turned coordinates.
FEW_DIMENSIONS, SIDES = 16, 6
SEED = 23


class ProductCode:
    """Filter directions made of one random codeword for each part of a rotated vector."""

    def __init__(self, dimensions: int, words: int, parts: int, seed: int) -> None:
        rng = np.random.default_rng(seed)
        parts = min(parts, dimensions)
        self.words = words
        self.rotation, _ = np.linalg.qr(rng.normal(size=(dimensions, dimensions)))
        self.bounds = np.linspace(0, dimensions, parts + 1).astype(int)
        self.books = []
        for a, b in zip(self.bounds, self.bounds[1:]):
            book = rng.normal(size=(words, b - a))
            self.books.append(book / np.linalg.norm(book, axis=1, keepdims=True) / np.sqrt(parts))

    def decode(self, units: np.ndarray, bound: float, least: int) -> list[np.ndarray]:
        """Numbers of all filters whose direction has a product of ``bound`` or more.

        Parts are decoded one after the other; beginnings that even the best rest
        cannot bring over the bound are left. For a vector with fewer than
        ``least`` filters the bound falls by steps until it has them.
        """
        turned = units @ self.rotation
        scores = [turned[:, a:b] @ book.T for book, a, b in zip(self.books, self.bounds, self.bounds[1:])]
        best = np.array([s.max(axis=1) for s in scores])
        found: list[np.ndarray] = [np.empty(0, np.int64)] * len(units)
        waiting = np.arange(len(units))
        while len(waiting):
            rows, numbers, sums = waiting, np.zeros(len(waiting), np.int64), np.zeros(len(waiting))
            for part, score in enumerate(scores):
                rest = best[part + 1 :].sum(axis=0)
                total = sums[:, None] + score[rows]
                at, word = np.nonzero(total + rest[rows][:, None] >= bound)
                rows, numbers, sums = rows[at], numbers[at] * self.words + word, total[at, word]
            counts = np.bincount(rows, minlength=len(units))
            for row, numbers_of in zip(waiting, np.split(numbers, np.cumsum(counts[waiting])[:-1])):
                found[row] = numbers_of
            waiting = waiting[counts[waiting] < least] if bound > -1 else waiting[:0]
            bound -= 0.03
        return found


def make_codes(dimensions: int, vectors: int) -> list[ProductCode]:
    """Codes for so many vectors, the same in every task."""
    words = max(FEWEST_WORDS, round(WORDS * (vectors / 50_000) ** 0.5))
    return [ProductCode(dimensions, words, PARTS, SEED + i) for i in range(CODES)]


def filters_of(units: np.ndarray, codes: list[ProductCode]) -> list[np.ndarray]:
    """Sorted filter numbers of every unit vector, over all codes.

    The bound is the one that a random vector exceeds for ``FILTERS`` directions.
    """
    directions = sum(code.words ** len(code.books) for code in codes)
    bound = NormalDist().inv_cdf(1 - min(0.5, FILTERS / directions)) / np.sqrt(units.shape[1])
    found = []
    for at in range(0, len(units), BATCH):
        lists = [code.decode(units[at : at + BATCH], bound, LEAST) for code in codes]
        size = codes[0].words ** len(codes[0].books)
        found += [np.sort(np.concatenate([one + i * size for i, one in enumerate(ones)])) for ones in zip(*lists)]
    return found


def boxes_of(units: np.ndarray, least: float) -> list[np.ndarray]:
    """Sorted numbers of the boxes a unit vector may share with one of cosine ``least`` or more; none is lost.

    Boxes are as wide as such vectors can be apart, and a vector is in all that come within half
    of that: two of them are both in the box of the point between them.
    """
    count, dimensions = units.shape
    turned = units @ np.linalg.qr(np.random.default_rng(SEED).normal(size=(dimensions, dimensions)))[0]
    width = max(np.sqrt(max(0.0, 2.0 - 2.0 * least)), 1e-3) * (1 + 1e-9)
    many = int(2 / width) + 4  # boxes along a side, from just below -1 on
    sides = min(SIDES, dimensions, int(62 / np.log2(many)))
    numbers = np.zeros((count, 1), np.int64)
    for side in turned.T[:sides]:
        ends = np.stack([np.floor((side + shift) / width) for shift in (1 - width / 2, 1 + width / 2)], axis=1).astype(np.int64) + 1
        numbers = (numbers[:, :, None] * many + ends[:, None, :]).reshape(count, -1)
    return [np.unique(row) for row in numbers]


def unit(vectors: np.ndarray) -> np.ndarray:
    """Vectors of length one; scaled first, so that squares stay finite."""
    vectors = vectors / np.abs(vectors).max(axis=-1, keepdims=True)
    return vectors / np.sqrt((vectors * vectors).sum(axis=-1, keepdims=True))


def small_pairs(bucket: np.ndarray, units: np.ndarray, smaller: list[np.ndarray], least: float) -> tuple[np.ndarray, np.ndarray]:
    """Linked pairs of rows in runs of equal ``bucket``, without those that share a ``smaller`` filter."""
    left, right = [], []
    for step in range(1, len(bucket)):
        at = np.flatnonzero(bucket[step:] == bucket[:-step])
        if not len(at):
            break
        for part in np.array_split(at, 1 + len(at) // 50_000):
            near = part[np.einsum("ij,ij->i", units[part], units[part + step]) >= least]
            left.append(near)
            right.append(near + step)
    if not left:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    left, right = np.concatenate(left), np.concatenate(right)
    first = np.fromiter((not len(np.intersect1d(smaller[i], smaller[j], assume_unique=True)) for i, j in zip(left, right)), bool, len(left))
    return left[first], right[first]


def large_pairs(units: np.ndarray, smaller: list[np.ndarray], least: float) -> np.ndarray:
    """Matrix of linked pairs of one filter, without those that share a ``smaller`` filter.

    Filters that two of the vectors have are looked at some thousand at a time.
    """
    linked = units @ units.T >= least
    np.fill_diagonal(linked, False)
    names, column, times = np.unique(np.concatenate(smaller), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(units)), [len(s) for s in smaller])
    place = np.cumsum(times > 1) - 1  # of the filters held twice or more
    row, column = row[times[column] > 1], place[column[times[column] > 1]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    for start in range(0, int(place[-1]) + 1 if len(names) else 0, COLUMNS):
        a, b = np.searchsorted(column, [start, start + COLUMNS])
        has = np.zeros((len(units), COLUMNS), np.float32)
        has[row[a:b], column[a:b] - start] = 1.0
        linked &= has @ has.T == 0
        if not linked.any():
            break
    return linked


def near_vectors(
    vectors: DataFrame,
    least: float = 0.93,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
) -> DataFrame:
    """Links and component of every vector, between equal labels with cosine >= ``least``.

    Equal vectors of a label are one class with a count, named by its smallest
    id. Each class is decoded to the spherical-cap filters it exceeds (or, under 16
    dimensions, to boxes that lose no link), classes meet in the filters they share (blocks of them where a filter has many), and
    cosines are verified in double precision. A pair counts in the first filter
    it shares only, so links are summed per vector without listing pairs, and a
    block passes on no more than one link per vector to the components.

    Returns one row per input row: ``row`` (struct of all input columns),
    ``n_links``, ``component_id``, ``kept``.

    Vectors that are null, empty, zero or hold null or non-finite components, and
    rows with a null label or id link with nothing: no links, and their own id as
    component. Vectors of different lengths do not link. Repeated rows count as
    vectors of their own. An empty table gives an empty result.
    """
    label, key, vector = F.col(f"`{label_col}`"), F.col(f"`{id_col}`"), F.col(f"`{vector_col}`")
    good = usable(vector) & label.isNotNull() & key.isNotNull()
    # -0.0 and 0.0 are one value; names of labels and vectors are hashed to 128 bits.
    exact = F.transform(vector, lambda x: x.cast("double") + F.lit(0.0))
    joined = F.to_json(F.struct(label, exact))
    rows = vectors.select(
        F.struct(*[F.col(f"`{c}`") for c in vectors.columns]).alias("row"),
        whole_ids(vectors, id_col).alias("id"),
        F.when(good, F.md5(joined.cast("binary"))).alias("of"),
        label.cast("string").alias("label"),
        exact.alias("vector"),
    )
    classes = cut(
        rows.where("of is not null")
        .groupBy("of")
        .agg(F.min("id").alias("rep"), F.count("*").alias("n"), F.min(F.struct("label", "vector")).alias("held"))
        .select("of", "rep", "n", "held.label", "held.vector")
    )

    number = classes.count()

    def decode(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        codes: dict[int, list[ProductCode]] = {}
        for frame in frames:
            sizes = frame["vector"].str.len()
            for size, part in frame.groupby(sizes, sort=False):
                units = unit(np.stack(part["vector"].to_numpy()).astype(np.float64))
                if size < FEW_DIMENSIONS:
                    filters = boxes_of(units, least)
                else:
                    if size not in codes:
                        codes[size] = make_codes(size, number)
                    filters = filters_of(units, codes[size])
                yield pd.DataFrame(
                    {
                        "rep": part["rep"].to_numpy(), "n": part["n"].to_numpy(),
                        "label": part["label"].to_numpy() + f" {size}",
                        "unit": [u.tobytes() for u in units], "filters": filters,
                    }
                )

    decoded = cut(classes.select("rep", "n", "label", "vector").mapInPandas(decode, "rep long, n long, label string, unit binary, filters array<long>"))
    slim = decoded.select("label", F.explode("filters").alias("filter"), F.col("rep").alias("member"))
    meeting = blocks(slim, ["label", "filter"], F.col("member"), BLOCK)
    meeting = meeting.join(decoded.select("rep", "n", "unit", "filters"), F.col("member") == F.col("rep")).drop("member")
    # A pair counts in the first filter it shares: only the filters before this one are looked at.
    meeting = meeting.withColumn("filters", F.filter("filters", lambda f: f < F.col("filter")))

    def compare(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["label", "filter", "lo", "hi", "rep"], ignore_index=True)
        bucket = frame.groupby(["label", "filter", "lo", "hi"], sort=False).ngroup().to_numpy()
        reps, n = frame["rep"].to_numpy(), frame["n"].to_numpy()
        chunk, lo, hi = (frame[c].to_numpy() for c in ("chunk", "lo", "hi"))
        smaller = frame["filters"].to_numpy()
        links, labels = np.zeros(len(frame), np.int64), np.arange(len(frame))
        starts = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
        sizes = np.diff(np.append(starts, len(bucket)))

        def units_of(at: np.ndarray) -> np.ndarray:
            raw = frame["unit"].iloc[at]
            width = len(raw.iloc[0])
            joined = np.frombuffer(b"".join(raw), np.float64) if (raw.str.len() == width).all() else None
            return joined.reshape(len(at), -1)

        def few(at: np.ndarray) -> None:
            """Small filters together, as long as their vectors have one length."""
            width = frame["unit"].iloc[at].str.len().to_numpy()
            for one in np.unique(width):
                part = at[width == one]
                left, right = small_pairs(bucket[part], units_of(part), smaller[part], least)
                left, right = part[left], part[right]
                np.add.at(links, left, n[right])
                np.add.at(links, right, n[left])
                merge(labels, left, right)

        few_rows = np.repeat((sizes <= SMALL) & (hi[starts] == lo[starts]), sizes)
        if few_rows.any():
            few(np.flatnonzero(few_rows))
        for start, size in zip(starts[~few_rows[starts]], sizes[~few_rows[starts]]):
            at = np.arange(start, start + size)
            linked = large_pairs(units_of(at), smaller[at], least)
            if lo[start] != hi[start]:  # pairs of one chunk meet in that chunk's own block
                linked &= chunk[at][:, None] != chunk[at][None, :]
            links[at] += linked @ n[at]
            left, right = np.nonzero(np.triu(linked))
            merge(labels, at[left], at[right])
        some = (links > 0) | (labels != np.arange(len(labels)))
        return pd.DataFrame({"rep": reps[some], "links": links[some], "first": reps[labels[some]]})

    keys = ["label", "filter", "lo", "hi"]
    found = cut(in_runs(meeting, keys, compare, "rep long, links long, first long"))
    sums = found.groupBy("rep").agg(F.sum("links").alias("links"))
    joined = connect(found.select(F.col("rep").alias("a"), F.col("first").alias("b")))
    named = (
        classes.select("of", "rep", "n")
        .join(sums, "rep", "left")
        .join(joined, F.col("rep") == F.col("node"), "left")
        .select(
            F.col("of").alias("is"),
            (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"),
            F.coalesce("component", "rep").alias("component_id"),
        )
    )
    told = rows.drop("label", "vector").join(named, F.col("of") == F.col("is"), "left")
    component = F.coalesce("component_id", "id")
    return told.select(
        "row",
        F.coalesce("n_links", F.lit(0)).alias("n_links"),
        component.alias("component_id"),
        F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"),
    )
