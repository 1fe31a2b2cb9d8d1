"""Helpers the operators share.

``cut`` computes a table once, into the folder of ``spark.checkpoint.dir``, which
all executors share; a lost executor loses none of it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..durable import checkpoint_folder as shared_folder
from ..durable import materialise as cut

#: The white space of the contracts: space and U+0009 to U+000D.
WHITE = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lowered(text: Column) -> Column:
    """``text`` with A-Z, and nothing else, in lower case."""
    return F.translate(text, UPPER, LOWER)


def finite(vector: Column) -> Column:
    """False for vectors that are null, empty or hold null or non-finite components."""
    odd = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return F.coalesce((F.size(vector) > 0) & ~odd, F.lit(False))


def whole_ids(rows: DataFrame, id_col: str) -> Column:
    """The ids as 64-bit integers; ids of another type raise, rather than being lost in a cast."""
    kind = rows.schema[id_col].dataType
    if not isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        raise ValueError(f"{id_col} must hold integers, not {kind.simpleString()}.")
    return F.col(f"`{id_col}`").cast("long")


def spread(*of: Column) -> Column:
    """60 bits of MD5 as a number: a uniform choice that any SQL engine can repeat."""
    joined = F.concat_ws("\x1f", *[c.cast("string") for c in of])
    return F.conv(F.substring(F.md5(joined.cast("binary")), 1, 15), 16, 10).cast("long")


def in_runs(
    df: DataFrame, keys: Sequence[str], work: Callable[[pd.DataFrame], pd.DataFrame], schema: str
) -> DataFrame:
    """Apply ``work`` to pandas frames that hold whole groups of ``keys``, many at a time.

    Rows are shuffled and sorted by the keys; a frame ends where a group ends.
    One call per group would cost more than the work itself where groups are
    small. A group has to fit into memory: split large ones first (``blocks``).
    """

    def runs(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for frame in frames:
            if not len(frame):
                continue
            same = (frame[list(keys)] == frame[list(keys)].iloc[-1]).all(axis=1).to_numpy()
            start = len(frame) - int(same[::-1].cumprod().sum())
            if start:
                yield work(pd.concat([*held, frame.iloc[:start]], ignore_index=True))
                held = [frame.iloc[start:]]
            elif held and not (held[-1][list(keys)].iloc[-1] == frame[list(keys)].iloc[0]).all():
                yield work(pd.concat(held, ignore_index=True))
                held = [frame]
            else:
                held.append(frame)
        if held:
            yield work(pd.concat(held, ignore_index=True))

    return df.repartition(*keys).sortWithinPartitions(*keys).mapInPandas(runs, schema)


def blocks(rows: DataFrame, keys: Sequence[str], of: Column, size: int) -> DataFrame:
    """Rows of groups with two rows or more, dealt to pairs of blocks.

    A group of n rows is split into ceil(n / size) chunks by the hash of ``of``.
    A row is copied to every pair of chunks that holds its own (``lo`` <= ``hi``;
    ``chunk`` is its own), so any two rows of a group meet in exactly one pair
    (two rows of one chunk in the pair of that chunk with itself).
    Groups of one row are left out, they hold no pair.
    """
    counts = rows.groupBy(*keys).agg(F.count("*").alias("_n")).where("_n > 1")
    parts = F.ceil(F.col("_n") / F.lit(size)).cast("int")
    dealt = rows.join(counts, list(keys)).withColumn("_parts", parts)
    dealt = dealt.withColumn("chunk", F.pmod(F.xxhash64(of), F.col("_parts")).cast("int"))
    dealt = dealt.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)))
    return dealt.select(
        *[F.col(f"`{c}`") for c in rows.columns],
        "chunk",
        F.least("chunk", "_other").alias("lo"),
        F.greatest("chunk", "_other").alias("hi"),
    )
