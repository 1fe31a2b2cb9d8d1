"""SimHash near-dedup: 64-bit fingerprints, near ones found with vantage-point trees."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks, cut, in_runs, whole_ids
from .components import connect, merge

SEED = 42
#: The tree is fitted on at most this many fingerprints, and on one in four at most.
SAMPLE = 16_384
#: Fingerprints in a shard, about, and at most in one block of a shard. A task
#: holds 16 bytes for each and splits them further with a tree of its own.
SHARD, BLOCK = 100_000, 200_000
#: Fingerprints that are compared with each other directly.
LEAF = 512


def fingerprint(text: str, words: int = 3) -> int:
    """Bits set in over half of the XXH64 hashes of a text's word shingles."""
    import xxhash

    parts = text.encode("utf-8", "replace").lower().split()  # bytes: A-Z and ASCII white space only
    if not parts:
        return 0
    if len(parts) < words:
        shingles, total = [b" ".join(parts)], 1
    else:
        shingles, total = map(b" ".join, zip(*[parts[i:] for i in range(words)])), len(parts) - words + 1
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(s, SEED) for s in shingles), np.uint64, total)
    counts = np.zeros(64, np.int64)
    for at in range(0, total, 1 << 15):
        bits = np.unpackbits(hashes[at : at + (1 << 15)].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int32)
    return int(np.packbits(counts * 2 > total, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, words: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``print`` (the fingerprint as a signed long) and ``check`` (a hash of the text) of every row."""

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            prints = np.array([fingerprint(t, words) for t in frame["text"]], np.uint64)
            yield pd.DataFrame({"doc_id": frame["doc_id"], "print": prints.view(np.int64), "check": frame["check"]})

    key = whole_ids(docs, id_col).cast("string")  # text, so that null ids survive pandas
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    rows = docs.select(key.alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("check"))
    found = rows.mapInPandas(work, "doc_id string, print long, check long")
    return found.withColumn("doc_id", F.col("doc_id").cast("long"))


class VantageTree:
    """Shards of Hamming space that overlap by the search distance.

    A node holds a vantage point and a radius. Points within radius + reach go
    inside, points beyond the radius outside. Of two points at most ``reach``
    apart, either both are beyond the radius, or one is within it and by the
    triangle inequality the other within radius + reach: one shard has both.
    """

    def __init__(self, points: np.ndarray, leaf: int, reach: int, seed: int = SEED) -> None:
        self.reach, self.shards = reach, 0
        self.root = self._split(points, leaf, np.random.default_rng(seed))

    def _split(self, points: np.ndarray, leaf: int, rng: np.random.Generator):
        if len(points) > leaf:
            for _ in range(3):
                vantage = points[rng.integers(len(points))]
                counts = np.bincount(np.bitwise_count(points ^ vantage), minlength=65 + self.reach)
                within = np.cumsum(counts)
                overlap = np.append(within[self.reach :], [within[-1]] * self.reach) - within
                middle = np.flatnonzero((within >= len(points) * 0.3) & (within <= len(points) * 0.7))
                if not len(middle):
                    continue
                radius = int(middle[np.argmin(overlap[middle])])
                if within[radius] + overlap[radius] > 0.95 * len(points):
                    continue  # no shell to cut along
                away = np.bitwise_count(points ^ vantage).astype(np.int64)
                inside = self._split(points[away <= radius + self.reach], leaf, rng)
                return vantage, radius, inside, self._split(points[away > radius], leaf, rng)
        self.shards += 1
        return self.shards - 1

    def route(self, points: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """(shard, positions of its points); a point can be in several shards."""
        waiting = [(self.root, np.arange(len(points)))]
        while waiting:
            node, at = waiting.pop()
            if not len(at):
                continue
            if isinstance(node, int):
                yield node, at
                continue
            vantage, radius, inside, outside = node
            away = np.bitwise_count(points[at] ^ vantage).astype(np.int64)
            waiting.append((inside, at[away <= radius + self.reach]))
            waiting.append((outside, at[away > radius]))


def near_labels(points: np.ndarray, reach: int) -> np.ndarray:
    """First position of each point's group, for links of at most ``reach`` bits; exact."""
    labels = np.arange(len(points))
    for _, at in VantageTree(points, LEAF, reach).route(points):
        part = points[at]
        for start in range(0, len(at), LEAF):
            left, right = np.nonzero(np.bitwise_count(part[start : start + LEAF, None] ^ part[None, :]) <= reach)
            left += start
            once = left < right
            merge(labels, at[left[once]], at[right[once]])
    return labels


def near_classes(prints: DataFrame, reach: int = 3) -> DataFrame:
    """Rows with ``doc_id`` and ``print``, and their ``component_id`` and ``component``.

    Rows of one fingerprint are one class, so copies never meet in pairs; links
    are between fingerprints, so rows of one id do not link their texts. A
    ``component`` is named by one of its fingerprints, and its ``component_id`` is its
    smallest id. A vantage-point tree, fitted on a bounded sample of the
    fingerprints, sends each class to every shard whose region it may reach.
    Shards, in blocks if they are large, are searched exactly with a tree of
    their own; a block returns at most one link per class, so links grow with the
    classes and not with pairs. Classes are then connected by joins.
    """
    prints = cut(prints)
    classes = cut(prints.where("doc_id is not null").groupBy("print").agg(F.min("doc_id").alias("rep")))
    size = classes.count()
    some = classes.where(F.pmod(F.xxhash64("print"), F.lit(max(4, -(-size // SAMPLE)))) == 0)
    sample = np.array([r[0] for r in some.select("print").limit(SAMPLE).collect()], np.int64).view(np.uint64)
    # Few large shards, as every cut copies rows, but enough for all cores.
    target = min(SHARD, size // (2 * prints.sparkSession.sparkContext.defaultParallelism))
    leaf = max(8, target * len(sample) // max(1, size))
    tree = VantageTree(np.sort(sample), leaf, reach)

    def route(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            points = frame["print"].to_numpy(np.int64)
            for shard, at in tree.route(points.view(np.uint64)):
                yield pd.DataFrame({"shard": shard, "print": points[at]})

    def search(frame: pd.DataFrame) -> pd.DataFrame:
        out = []
        for _, rows in frame.groupby(["shard", "lo", "hi"], sort=False):
            points = np.sort(rows["print"].to_numpy(np.int64))
            labels = near_labels(points.view(np.uint64), reach)
            linked = labels != np.arange(len(labels))
            out.append(pd.DataFrame({"a": points[linked], "b": points[labels[linked]]}))
        return pd.concat(out, ignore_index=True)

    routed = classes.select("print").mapInPandas(route, "shard int, print long")
    paired = blocks(cut(routed), ["shard"], F.col("print"), BLOCK).drop("chunk")
    joined = connect(in_runs(paired, ["shard", "lo", "hi"], search, "a long, b long"))
    # Only classes with links need their component's smallest id.
    linked = cut(joined.union(joined.select("component", "component").distinct()))
    firsts = linked.join(classes, F.col("node") == F.col("print")).groupBy("component").agg(F.min("rep").alias("first"))
    named = linked.join(firsts, "component").select(F.col("node").alias("of"), "component", "first")
    named = classes.join(named, F.col("print") == F.col("of"), "left").select(
        F.col("print").alias("of"), F.coalesce("first", "rep").alias("component_id"), F.coalesce("component", "print").alias("component")
    )
    known = prints.where("doc_id is not null").join(named, F.col("print") == F.col("of")).drop("of")
    nothing = F.lit(None).cast("long")
    unknown = prints.where("doc_id is null").select("*", nothing.alias("component_id"), nothing.alias("component"))
    return known.unionByName(unknown)


def simhash_classes(docs: DataFrame, words: int = 3, reach: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprint and component of every document.

    Two documents are linked if their fingerprints differ in at most ``reach``
    bits; a component is named by its smallest id. Texts without words have the
    fingerprint zero and are linked like any other. Rows with a null id take no
    part in links and get a null component. Repeated rows share their result. An
    empty table gives an empty result. Columns: ``doc_id``, ``fingerprint``
    (16 hex digits), ``component_id``.
    """
    found = near_classes(fingerprints(docs, words, id_col, text_col), reach)
    digits = F.lower(F.lpad(F.hex("print"), 16, "0"))
    return found.select("doc_id", digits.alias("fingerprint"), "component_id")


def keep_one_per_class(docs: DataFrame, words: int = 3, reach: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The document with the smallest id of every component, all columns as given.

    Rows of one id whose texts are in different components are kept apart: of each
    component one row with its smallest id stays. Rows with a null id all stay.
    """
    found = near_classes(fingerprints(docs, words, id_col, text_col), reach)
    firsts = found.where("doc_id = component_id").groupBy("doc_id", "component").agg(F.min("check").alias("check"))
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(f"`{id_col}`").alias("doc_id"), F.xxhash64(text).alias("check"))
    kept = rows.where("doc_id is not null").join(firsts.select("doc_id", "check"), ["doc_id", "check"], "left_semi")
    kept = kept.dropDuplicates(["doc_id", "check"])
    return kept.select("row.*").union(rows.where("doc_id is null").select("row.*"))
