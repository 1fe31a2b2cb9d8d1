"""Approximate nearest neighbours by inner product, with an inverted multi-index."""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, spread, whole_ids

#: Vectors the index is fitted on at most, and those of them it is tuned with.
SAMPLE, TUNING = 8_192, 256
#: Rows of a length below which they are one cell.
FITTED = 64
#: Centroids of each half, at least and at most; cells are the square of it, and
#: hold about so many entries.
FEWEST, MOST, FILL = 8, 256, 1_000
#: Recall on the tuning sample that decides how far the cells are traversed.
RECALL = 0.95
#: A length has about ``BLOCKS`` blocks of entries, or more, of so many entries at least and at most.
BLOCKS, FEW, MANY = 16, 8_192, 262_144
#: Queries that meet a block in one task at most; numbers in their vectors, and their neighbours, at most.
QUERIES, NUMBERS, FOUND = 65_536, 2**22, 2**21
#: Products computed at once, about.
TILE = 2**21
SEED = 11


def usable(vector: Column) -> Column:
    """False for vectors that are null, empty, zero or hold null or non-finite components."""
    odd = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    zero = F.forall(vector, lambda x: x == 0)
    return F.coalesce((F.size(vector) > 0) & ~odd & ~zero, F.lit(False))


def k_means(points: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 12) -> np.ndarray:
    """Centroids of at most ``k`` groups."""
    centres = points[rng.choice(len(points), min(k, len(points)), replace=False)]
    for _ in range(rounds):
        nearest = nearest_centre(points, centres)
        counts = np.bincount(nearest, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, nearest, points)
        centres = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], centres)
    return centres


def nearest_centre(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Position of each point's nearest centre."""
    away = (centres * centres).sum(axis=1)[None, :] - 2.0 * points @ centres.T
    return away.argmin(axis=1)


@dataclass
class MultiIndex:
    """Centroids of the two halves, entries per cell, and entries a query has to see."""

    left: np.ndarray
    right: np.ndarray
    counts: np.ndarray  # (left, right)
    share: float

    @property
    def half(self) -> int:
        """Dimensions of the left half."""
        return self.left.shape[1]

    def cells(self, vectors: np.ndarray) -> np.ndarray:
        """Cell of each vector: the pair of its halves' nearest centroids."""
        left = nearest_centre(vectors[:, : self.half], self.left)
        return left * len(self.right) + nearest_centre(vectors[:, self.half :], self.right)

    def traverse(self, query: np.ndarray) -> Iterator[int]:
        """Cells by falling sum of the halves' inner products (multi-sequence with a heap)."""
        a, b = self.left @ query[: self.half], self.right @ query[self.half :]
        first, second = np.argsort(-a, kind="stable"), np.argsort(-b, kind="stable")
        heap, pushed = [(-(a[first[0]] + b[second[0]]), 0, 0)], {(0, 0)}
        while heap:
            _, i, j = heapq.heappop(heap)
            yield int(first[i]) * len(second) + int(second[j])
            for x, y in ((i + 1, j), (i, j + 1)):
                if x < len(first) and y < len(second) and (x, y) not in pushed:
                    pushed.add((x, y))
                    heapq.heappush(heap, (-(a[first[x]] + b[second[y]]), x, y))

    def sums(self, queries: np.ndarray) -> np.ndarray:
        """Sum of the halves' inner products with the centroids: a row per query, a column per cell."""
        a, b = queries[:, : self.half] @ self.left.T, queries[:, self.half :] @ self.right.T
        return (a[:, :, None] + b[:, None, :]).reshape(len(queries), -1)

    def bounds(self, queries: np.ndarray, least: int) -> np.ndarray:
        """Least sum of the cells a query sees: by falling sum, until the share of all entries (and ``least``) is seen.

        Lower by more than the last digits of a sum, which depend on how many are computed at once.
        """
        flat = self.counts.reshape(-1)
        filled = np.flatnonzero(flat)
        wanted = max(self.share * flat.sum(), least)
        found = np.full(len(queries), -np.inf)
        for at in range(len(queries)):
            sums = self.sums(queries[at : at + 1])[0, filled]
            order = np.argsort(-sums, kind="stable")
            last = np.searchsorted(np.cumsum(flat[filled][order]), wanted)
            if last < len(order):
                found[at] = sums[order[last]]
        longest = max(np.linalg.norm(half, axis=1).max(initial=0) for half in (self.left, self.right))
        return found - 1e-12 * longest * np.linalg.norm(queries, axis=1)


def fit_index(vectors: np.ndarray, k: int, rows: int, recall: float = RECALL) -> MultiIndex:
    """Fit the centroids to a sample of ``rows``, and how far to go to find its true neighbours."""
    rng = np.random.default_rng(SEED)
    half = max(1, vectors.shape[1] // 2)
    centroids = int(min(MOST, max(FEWEST, (rows / FILL) ** 0.5)))
    left = k_means(vectors[:, :half], centroids, rng)
    right = k_means(vectors[:, half:], centroids, rng)
    index = MultiIndex(left, right, np.zeros((len(left), len(right)), np.int64), 1.0)
    cells = index.cells(vectors)
    index.counts = np.bincount(cells, minlength=index.counts.size).reshape(index.counts.shape)
    tried = rng.choice(len(vectors), min(TUNING, len(vectors)), replace=False)
    shares: list[np.ndarray] = []
    for at in tried:
        near = vectors @ vectors[at]
        near[at] = -np.inf
        best = np.argpartition(-near, min(k, len(near) - 1))[:k]
        best = best[best != at]
        order = np.fromiter(index.traverse(vectors[at]), np.int64)
        upto = np.cumsum(index.counts.reshape(-1)[order]) / len(vectors)
        place = np.empty(index.counts.size, np.int64)
        place[order] = np.arange(len(order))
        shares.append(upto[place[cells[best]]])
    found = np.concatenate(shares) if shares else np.ones(1)
    index.share = float(np.quantile(found, recall)) if len(found) else 1.0
    return index


def scores(entries: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Inner products in double precision; equal vectors get equal numbers."""
    return (entries * query).sum(axis=1)


def matrix(vectors: pa.Array) -> np.ndarray:
    """Vectors of one length as rows."""
    return vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False).reshape(len(vectors), -1)


def by_length(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.RecordBatch]]:
    """Rows of each length apart."""
    for batch in batches:
        lengths = pc.list_value_length(batch.column("vector")).to_numpy(zero_copy_only=False)
        for width in np.unique(lengths).tolist():
            yield width, batch.filter(pa.array(lengths == width))


def mixed(ids: np.ndarray, owns: np.ndarray) -> np.ndarray:
    """Hash of each row, to deal rows with; neither many equal ids nor equal vectors make it uneven."""
    found = ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + owns.astype(np.uint64)
    found = (found ^ (found >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return (found ^ (found >> np.uint64(32))).astype(np.int64) & 0x7FFFFFFF


@dataclass
class Layout:
    """Blocks of one length: each range of cells is one, or several if it is a single large cell."""

    starts: np.ndarray  # first cell of each range
    first: np.ndarray  # first block of each range
    parts: np.ndarray  # blocks of each range


def lay_out(counts: np.ndarray, first: int) -> Layout:
    """Ranges of cells with about as many entries each; blocks are numbered from ``first``."""
    size = min(MANY, max(FEW, -(-int(counts.sum()) // BLOCKS)))
    starts: list[int] = []
    parts: list[int] = []
    held = 0
    for cell, n in enumerate(counts.tolist()):
        if not starts or parts[-1] > 1 or held + n > size:
            starts.append(cell)
            parts.append(max(1, -(-n // size)))
            held = 0
        held += n
    blocks = np.array(parts)
    return Layout(np.array(starts), first + np.cumsum(blocks) - blocks, blocks)


class Panel:
    """Queries that meet a block of entries, and the ``k`` best entries of each so far.

    Entries pass by, a run of one cell at a time. What is held are the queries,
    ``k`` entries for each, and one tile of products, whatever the block holds.
    """

    def __init__(self, index: MultiIndex | None, k: int):
        self.index, self.k = index, k
        self.asked: list[tuple[np.ndarray, ...]] = []
        self.kept = self.none = (np.empty(0, np.int64), np.empty(0), np.empty(0, np.int64), np.empty(0, np.int64))
        self.fresh: list[tuple[np.ndarray, ...]] = []
        self.ids = self.floor = np.empty(0)

    def ask(self, *queries: np.ndarray) -> None:
        """Add queries: ids, owns, bounds and vectors."""
        self.asked.append(queries)

    def meet(self, cell: int, ids: np.ndarray, owns: np.ndarray, times: np.ndarray, values: np.ndarray) -> None:
        """Compare entries of ``cell`` with the queries that see it."""
        if self.asked:
            self.ids, self.owns, self.bounds, self.vectors = map(np.concatenate, zip(*self.asked))
            self.floor, self.asked = np.full(len(self.ids), -np.inf), []
        if not len(self.ids):
            return
        seen = np.arange(len(self.ids))
        if self.index is not None:
            half, (i, j) = self.index.half, divmod(cell, len(self.index.right))
            sums = self.vectors[:, :half] @ self.index.left[i] + self.vectors[:, half:] @ self.index.right[j]
            seen = np.flatnonzero(sums >= self.bounds)
        some = self.first_of_equals(ids, owns, values)
        ids, owns, times, values = ids[some], owns[some], times[some], values[some]
        step = max(1, TILE // len(ids))
        for start in range(0, len(seen), step):
            self.tile(seen[start : start + step], ids, owns, times, values)

    def first_of_equals(self, ids: np.ndarray, owns: np.ndarray, values: np.ndarray) -> np.ndarray:
        """Positions without rows that ``k`` + 1 rows with the same vector and a smaller id precede."""
        order = np.lexsort((ids, owns))
        same = np.zeros(len(order), bool)
        same[1:] = owns[order][1:] == owns[order][:-1]
        at = np.flatnonzero(same)
        if len(at) <= self.k:
            return order
        same[at] = (values[order[at]] == values[order[at - 1]]).all(axis=1)
        places = np.arange(len(order))
        return order[places - np.maximum.accumulate(np.where(same, 0, places)) <= self.k]

    def tile(self, asked: np.ndarray, ids: np.ndarray, owns: np.ndarray, times: np.ndarray, values: np.ndarray) -> None:
        questions, floor, k = self.vectors[asked], self.floor[asked], self.k
        rough = questions @ values.T

        def above(rows: np.ndarray | slice) -> np.ndarray:
            # Ties and the last digits are settled on the exact sums of all that may be among the best.
            return rough[rows] >= (floor[rows] - 1e-9 * (1.0 + abs(floor[rows])))[:, None]

        hits = above(slice(None))
        many = np.flatnonzero(np.count_nonzero(hits, axis=1) > 2 * (k + 1))
        if len(many):
            # The query itself may be one of the k + 1.
            least = np.partition(rough[many], len(ids) - k - 1, axis=1)[:, len(ids) - k - 1]
            floor[many] = np.maximum(floor[many], least)
            hits[many] = above(many)
            self.floor[asked] = floor
        all_rows, all_columns = np.nonzero(hits)
        step = max(1, TILE // values.shape[1])
        for start in range(0, len(all_rows), step):
            rows, columns = all_rows[start : start + step], all_columns[start : start + step]
            exact, who = scores(values[columns], questions[rows]), asked[rows]
            left = times[columns] - ((ids[columns] == self.ids[who]) & (owns[columns] == self.owns[who]))
            real = left > 0
            self.fresh.append((who[real], exact[real], ids[columns[real]], left[real]))
            if sum(len(x[0]) for x in self.fresh) > max(2**17, len(self.kept[0]) // 2):
                self.settle()

    def settle(self) -> None:
        """Keep the best of each query; the last of ``k`` is the floor for others."""
        who, exact, ids, left = map(np.concatenate, zip(self.kept, *self.fresh))
        order = np.lexsort((ids, -exact, who))
        who = who[order]
        places = np.arange(len(who))
        starts = np.maximum.accumulate(np.where(np.r_[True, who[1:] != who[:-1]], places, 0)) if len(who) else places
        order, who, places = (x[places - starts < self.k] for x in (order, who, places - starts))
        self.kept, self.fresh = (who, exact[order], ids[order], left[order]), []
        full = places == self.k - 1
        self.floor[who[full]] = np.maximum(self.floor[who[full]], exact[order][full])

    def best(self) -> Iterator[pa.RecordBatch]:
        """The best entries of all queries, and an end."""
        self.settle()
        who, exact, ids, left = self.kept
        for start in range(0, len(who), 2**16):
            part = slice(start, start + 2**16)
            columns = [self.ids[who[part]], self.owns[who[part]], ids[part], exact[part], left[part]]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["query_id", "query_own", "vec_id", "score", "times"])


def nearest(
    vectors: DataFrame,
    queries: DataFrame,
    k: int = 20,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
) -> DataFrame:
    """The ``k`` rows of ``vectors`` with the largest inner product for every query row.

    The halves of a vector are quantised apart, each to one of 8 to 256 centroids, and
    a vector is an entry of the cell of its pair. A query traverses cells by the
    sum of its halves' products with the centroids, through a heap, until it has
    seen a share of all entries; that share is the one that finds 95 % of the
    true neighbours in a bounded sample. Entries of the cells seen are reranked
    exactly. All rows are indexed; only the fit uses a sample.

    Ranges of cells are blocks of entries, and a large cell is several, so a cell with
    a third of all rows is many tasks. A query goes once to each block it sees cells of,
    with the least sum of its cells. A task holds some thousand queries with at most
    ``k`` rows each while a block's entries pass by; these rows are merged per query with
    a top-k. Vectors of floats travel as floats, and all sums are in double precision.

    Returns ``query_id``, ``rank`` (from 1), ``vec_id``, ``score``; ties go to the
    smaller id. A query is not its own neighbour, but other rows with its id are,
    also exact repetitions: equal rows are one entry with their number, which is
    one less for the query's own, and queries that repeat get their rows each.
    Vectors of different lengths have no product: each length is indexed apart,
    and one with few rows is a single cell. Vectors that are null, empty, zero, or
    hold null or non-finite components take no part, nor do null ids; ids that
    are no integers raise. With fewer than ``k`` candidates all are returned.
    Empty tables give an empty result.
    """
    vector = F.col(f"`{vector_col}`")
    kinds = [rows.schema[vector_col].dataType for rows in (vectors, queries)]
    number = "float" if all(isinstance(getattr(kind, "elementType", None), T.FloatType) for kind in kinds) else "double"

    def clean(rows: DataFrame) -> DataFrame:
        rows = rows.select(whole_ids(rows, id_col).alias("id"), vector.cast(f"array<{number}>").alias("vector"))
        rows = rows.where(F.col("id").isNotNull() & usable(F.col("vector")))
        rows = rows.groupBy("id", "vector").agg(F.count("*").alias("times"))
        return rows.select("id", F.xxhash64(F.col("vector").cast("array<double>")).alias("own"), "times", "vector")

    rows = cut(clean(vectors))
    width = F.size("vector").alias("width")
    indexes: dict[int, MultiIndex] = {}
    lengths = dict(rows.groupBy(width).count().collect())  # one row per length
    for length, many in lengths.items():
        if many >= FITTED:
            sample = rows.where(F.size("vector") == length).orderBy(spread(F.col("id")), "id", "own").limit(SAMPLE)
            indexes[length] = fit_index(np.array([r[0] for r in sample.select("vector").collect()]), k, many)

    def cells(length: int, batch: pa.RecordBatch) -> np.ndarray:
        return indexes[length].cells(matrix(batch.column("vector"))) if length in indexes else np.zeros(len(batch), np.int64)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for length, batch in by_length(batches):
            held, n = np.unique(cells(length, batch), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(held), length, np.int32)), pa.array(held), pa.array(n)], ["width", "cell", "n"])

    counts = rows.mapInArrow(count, "width int, cell long, n long").groupBy("width", "cell").agg(F.sum("n").alias("n"))
    for index in indexes.values():
        index.counts = np.zeros_like(index.counts)
    for row in counts.collect():  # at most MOST^2 for a length, or one
        if row["width"] in indexes:
            indexes[row["width"]].counts.reshape(-1)[row["cell"]] = row["n"]
    layouts: dict[int, Layout] = {}
    most: list[int] = []  # queries that meet each block in a task
    for length, n in lengths.items():
        layouts[length] = lay_out(indexes[length].counts.reshape(-1) if length in indexes else np.array([n]), len(most))
        most += [max(1, min(QUERIES, NUMBERS // length, FOUND // k))] * int(layouts[length].parts.sum())

    def bound(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for length, batch in by_length(batches):
            bounds = indexes[length].bounds(matrix(batch.column("vector")), k + 1) if length in indexes else np.full(len(batch), -np.inf)
            yield batch.append_column("bound", pa.array(bounds))

    asked = cut(clean(queries).mapInArrow(bound, f"id long, own long, times long, vector array<{number}>, bound double"))

    def sent(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
        """Queries and the blocks they see cells of."""
        for length, batch in by_length(batches):
            if length not in layouts:
                continue
            index, layout = indexes.get(length), layouts[length]
            step = max(1, min(TILE // (index.counts.size if index else 1), TILE // (64 * len(layout.starts))))
            for start in range(0, len(batch), step):
                part = batch.slice(start, step)
                hits = np.ones((len(part), 1), bool)
                if index:
                    sees = index.sums(matrix(part.column("vector"))) >= part.column("bound").to_numpy()[:, None]
                    hits = np.logical_or.reduceat(sees & (index.counts.reshape(-1) > 0), layout.starts, axis=1)
                at, ranges = np.nonzero(hits)
                parts = layout.parts[ranges]
                blocks = np.repeat(layout.first[ranges] - np.cumsum(parts) + parts, parts) + np.arange(parts.sum())
                yield part.take(pa.array(np.repeat(at, parts))), blocks

    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, blocks in sent(batches):
            held, n = np.unique(blocks, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(n)], ["block", "n"])

    # Queries of one block are split as well; its entries go to each of the splits, if there are any.
    splits = np.zeros(len(most), np.int64)
    for row in asked.mapInArrow(tell, "block long, n long").groupBy("block").agg(F.sum("n").alias("n")).collect():
        splits[row["block"]] = -(-row["n"] // most[row["block"]])
    names = ["block", "split", "cell", "id", "own", "times", "bound", "vector"]
    table = f"block int, split int, cell int, id long, own long, times long, bound double, vector array<{number}>"

    def dealt(batch: pa.RecordBatch, blocks: np.ndarray, split: np.ndarray, cells: np.ndarray, bounds: pa.Array) -> pa.RecordBatch:
        first = [pa.array(x.astype(np.int32)) for x in (blocks, split, cells)]
        return pa.RecordBatch.from_arrays([*first, *(batch.column(c) for c in ("id", "own", "times")), bounds, batch.column("vector")], names)

    def hashes(batch: pa.RecordBatch) -> np.ndarray:
        return mixed(batch.column("id").to_numpy(), batch.column("own").to_numpy())

    def deal_queries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, blocks in sent(batches):
            yield dealt(batch, blocks, hashes(batch) % splits[blocks], np.full(len(batch), -1), batch.column("bound"))

    def deal_entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Entries with the number of splits their block has."""
        for length, batch in by_length(batches):
            layout, at = layouts[length], cells(length, batch)
            ranges = np.searchsorted(layout.starts, at, side="right") - 1
            blocks = layout.first[ranges] + hashes(batch) % layout.parts[ranges]
            out = dealt(batch, blocks, splits[blocks], at, pa.nulls(len(batch), pa.float64()))
            yield out.filter(pa.array(splits[blocks] > 0))

    entries = rows.mapInArrow(deal_entries, table)
    entries = entries.withColumn("split", F.explode(F.sequence(F.lit(0), F.col("split") - 1)))
    # Queries come before the entries: no cell is below 0.
    both = entries.select(names).union(asked.mapInArrow(deal_queries, table))
    tasks = int(min(4_000, max(1, 4 * splits.sum())))
    both = both.repartition(tasks, "block", "split").sortWithinPartitions("block", "split", "cell")

    def rerank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        panel, place = None, None
        for batch in batches:
            blocks, parts, at = (batch.column(c).to_numpy() for c in names[:3])
            turns = np.flatnonzero((blocks[1:] != blocks[:-1]) | (parts[1:] != parts[:-1]) | (at[1:] != at[:-1])) + 1
            for start, end in zip([0, *turns.tolist()], [*turns.tolist(), len(batch)]):
                if start == end:
                    continue
                run = batch.slice(start, end - start)
                values = matrix(run.column("vector"))
                if place != (blocks[start], parts[start]):
                    if panel:
                        yield from panel.best()
                    panel, place = Panel(indexes.get(values.shape[1]), k), (blocks[start], parts[start])
                ids, owns = run.column("id").to_numpy(), run.column("own").to_numpy()
                if at[start] < 0:
                    panel.ask(ids, owns, run.column("bound").to_numpy(), values)
                else:
                    panel.meet(int(at[start]), ids, owns, run.column("times").to_numpy(), values)
        if panel:
            yield from panel.best()

    found = both.mapInArrow(rerank, "query_id long, query_own long, vec_id long, score double, times long")
    order = Window.partitionBy("query_id", "query_own").orderBy(F.desc("score"), "vec_id")
    first = found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)
    before = F.coalesce(F.sum("times").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    room = F.least(F.col("times"), k - before)
    copies = first.withColumn("before", before).withColumn("room", room).where(F.col("room") > 0)
    copies = copies.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("room").cast("int"))))
    ranked = copies.withColumn("rank", (F.col("before") + F.col("copy")).cast("int"))
    again = asked.where("times > 1").select(F.col("id").alias("query_id"), F.col("own").alias("query_own"), F.col("times").alias("asked"))
    ranked = ranked.join(again, ["query_id", "query_own"], "left")
    ranked = ranked.withColumn("asked", F.explode(F.sequence(F.lit(1), F.coalesce(F.col("asked"), F.lit(1)).cast("int"))))
    return ranked.select("query_id", "rank", "vec_id", "score")
