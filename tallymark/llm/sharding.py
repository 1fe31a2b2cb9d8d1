"""Sharding: groups that stay together go to the least-loaded shard, largest first."""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

#: Items the heap places are at most twice this many per shard.
GRAIN = 256
#: Rows of a shard that are numbered in one task, about.
ROWS_PER_CHUNK = 50_000


def longest_first(items: list[tuple[str, int]], shards: int) -> dict[str, int]:
    """Longest processing time: largest item first, to the least-loaded shard.

    Ties go to the smaller name and the smaller shard number.
    """
    heap = [(0, shard) for shard in range(shards)]
    placed = {}
    for name, size in sorted(items, key=lambda item: (-item[1], item[0])):
        load, shard = heapq.heappop(heap)
        placed[name] = shard
        heapq.heappush(heap, (load + size, shard))
    return placed


def shard_documents(
    docs: DataFrame, shards: int = 24, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Deal documents to shards of nearly equal bytes; equal texts share a shard.

    Sizes are summed per group of equal texts (combined before the shuffle). A
    group with at least 1 / (shards * GRAIN) of all bytes is an item of its own,
    and there can be no more than shards * GRAIN of them; all other groups are
    dealt by hash to shards * GRAIN bundles. The heap then places groups and
    bundles, a number of items that does not grow with the data, and the map of
    items to shards, with the same bound, is broadcast back. No shard exceeds
    another by more than one item, so by 1 / GRAIN of a shard or the largest
    group. A group is never split, also where it is larger than a fair shard.

    Slots number the rows of a shard without gaps. A shard is cut into chunks by
    row, each chunk is numbered by itself and starts where the chunks before end,
    so no task sorts a whole shard.

    Returns ``row`` (struct of all input columns), ``size`` (UTF-8 bytes + 8),
    ``text_crc32``, ``shard``, ``slot``.

    A null text has no bytes and belongs with the empty texts. Rows with null ids
    are dealt like any other; repeated rows go to one shard and get a slot each.
    An empty table gives an empty result.
    """
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    spark = docs.sparkSession
    # The position is taken once, here; afterwards it is data. Texts stay behind.
    slim = cut(
        docs.select(
            F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != text_col]).alias("rest"),
            F.monotonically_increasing_id().alias("at"),
            (F.octet_length(text) + F.lit(8)).cast("long").alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            F.md5(text.cast("binary")).alias("group"),
        )
    )
    groups = cut(slim.groupBy("group").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows")))
    total = groups.agg(F.sum("bytes")).first()[0] or 0
    large = F.col("bytes") * F.lit(shards * GRAIN) >= F.lit(total)
    bundle = F.concat(
        F.lit("bundle "), F.conv(F.substring("group", 1, 15), 16, 10).cast("long") % (shards * GRAIN)
    )
    items = (
        groups.select(F.when(large, F.col("group")).otherwise(bundle).alias("item"), "bytes", "rows")
        .groupBy("item")
        .agg(F.sum("bytes").alias("bytes"), F.sum("rows").alias("rows"))
        .collect()  # at most 2 * shards * GRAIN
    )
    placed = longest_first([(item["item"], item["bytes"]) for item in items], shards)
    rows_of = [0] * shards
    for item in items:
        rows_of[placed[item["item"]]] += item["rows"]
    chunks = [max(1, -(-rows // ROWS_PER_CHUNK)) for rows in rows_of]
    places = F.broadcast(
        spark.createDataFrame(
            [(name, shard, chunks[shard]) for name, shard in placed.items()],
            "item string, shard int, chunks int",
        )
    )
    # A large group is found by its own name, all others by their bundle.
    own = places.select(F.col("item").alias("own"), F.col("shard").alias("own_shard"), F.col("chunks").alias("own_chunks"))
    dealt = (
        slim.join(own, F.col("group") == F.col("own"), "left")
        .withColumn("item", bundle)
        .join(places, "item", "left")
        .select(
            "rest", "at", "size", "text_crc32",
            F.coalesce("own_shard", "shard").alias("shard"),
            F.coalesce("own_chunks", "chunks").alias("chunks"),
        )
        .withColumn("chunk", F.pmod(F.xxhash64("at"), F.col("chunks")).cast("int"))
    )
    per_chunk = dealt.groupBy("shard", "chunk").agg(F.count("*").alias("rows"))
    before = Window.partitionBy("shard").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    starts = per_chunk.select(
        "shard", "chunk", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("start")
    )
    inside = Window.partitionBy("shard", "chunk").orderBy(F.col(f"rest.`{id_col}`"), "at")
    numbered = dealt.withColumn("inside", F.row_number().over(inside) - 1)
    return numbered.join(starts, ["shard", "chunk"]).select(
        F.col("rest").alias("row"), "size", "text_crc32", "shard", (F.col("start") + F.col("inside")).alias("slot")
    )
