"""Costs from a table of prices that change over time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..durable import materialise
from ..functions.coercion import round_half_even
from .columns import col, require_columns

#: Model names with prices up to which they are broadcast; beyond, usage is shuffled by name.
BROADCAST_NAMES = 100_000
#: Bits of the table that tells most parts of names from keys: so many for a price, and at most, which makes 35 MB.
KEY_BITS, MOST_BITS = 64, 1 << 28


def _whole(prices: Column) -> Column:
    """Whether prices, the first column of each being its begin and the second its end in microseconds, leave no moment out."""
    least, most = F.lit(-(2**63) + 1), F.lit(2**63 - 1)
    spans = F.array_sort(F.transform(prices, lambda p: F.struct(F.coalesce(F.unix_micros(p["_from"]), least).alias("a"), F.coalesce(F.unix_micros(p["_to"]), most).alias("b"))))
    return F.aggregate(spans, least, lambda reach, s: F.when(s["a"] <= reach, F.greatest(reach, s["b"])).otherwise(reach)) == most


def _perhaps_keys(parts: DataFrame, keys: DataFrame, prices: int) -> DataFrame:
    """Rows of ``parts`` without most of those whose ``_key`` is no key; none that is one is lost.

    Hashes of the keys are bits of a table, whose rows, of 64 words, are broadcast.
    """
    bits = min(max(KEY_BITS * prices, 1 << 16), MOST_BITS)
    place = F.pmod(F.xxhash64("_key"), F.lit(bits))
    words = keys.select(place.alias("_at")).groupBy(F.expr("_at >> 6").alias("_at")).agg(F.expr("bit_or(shiftleft(1L, CAST(_at & 63 AS INT)))").alias("_set"))
    table = words.groupBy(F.expr("_at >> 6").alias("_block")).agg(F.map_from_entries(F.collect_list(F.struct(F.expr("CAST(_at & 63 AS INT)"), "_set"))).alias("_map"))
    table = table.select("_block", F.expr("transform(sequence(0, 63), i -> coalesce(try_element_at(_map, i), 0L))").alias("_words"))
    set_bit = F.expr("shiftright(_words[CAST(_at >> 6 & 63 AS INT)], CAST(_at & 63 AS INT)) & 1L = 1L")
    asked = parts.withColumn("_at", place)
    return asked.join(F.broadcast(table), (F.expr("_at >> 12") == F.col("_block")) & set_bit, "left_semi").drop("_at")


def price_usage(
    usage: DataFrame,
    prices: DataFrame,
    *,
    model: str = "model",
    prompt: str = "prompt_tokens",
    completion: str = "completion_tokens",
    at: str | None = None,
    precision: int = 8,
) -> DataFrame:
    """``usage`` with ``estimated_cost_usd`` by the longest ``model_key`` in the model name with a price in force.

    ``prices`` has ``model_key``, ``input_per_million``, ``output_per_million`` and, if ``at``
    names a time of the usage, ``valid_from`` (inclusive) and ``valid_to`` (exclusive); a null end
    is open. Keys are compared in lower case. Of equally long keys the first in
    order counts, of prices of one key the latest begun.

    Each distinct model name is looked up once: its parts of the lengths that keys have
    are joined with the keys, so the cost does not grow with names times keys.
    Parts that are no key go before anything is shuffled, but for a few.
    What a usage row meets is the list of its name's prices, the best first, up to
    the first key that always has a price.

    Usage without a matching price, with incomplete rates, or with a null model,
    token number or (where it is asked for) time costs 0. Blank keys match nothing.
    """
    require_columns(usage, [model, prompt, completion, *([at] if at else [])])
    require_columns(prices, ["model_key", "input_per_million", "output_per_million", *(["valid_from", "valid_to"] if at else [])])
    known = prices.select(
        F.lower(F.col("model_key").cast("string")).alias("_key"),
        (F.col("valid_from") if at else F.lit(None)).cast("timestamp").alias("_from"),
        (F.col("valid_to") if at else F.lit(None)).cast("timestamp").alias("_to"),
        F.col("input_per_million").cast("double").alias("_in"),
        F.col("output_per_million").cast("double").alias("_out"),
    ).where(F.length("_key") > 0)
    begun = F.coalesce(-F.unix_micros("_from"), F.lit(2**62))
    price = F.struct(begun.alias("begun"), "_from", "_to", "_in", "_out")
    keys = known.groupBy("_key").agg(F.array_sort(F.collect_list(price)).alias("_held")).withColumn("_whole", _whole(F.col("_held")))
    sizes = known.groupBy(F.length("_key").alias("size")).count().collect()  # no more than the longest key has letters
    name = F.lower(col(model).cast("string"))
    names = usage.select(name.alias("_name")).where("_name is not null").distinct()
    sized = names.select("_name", F.explode(F.array(*[F.lit(r["size"]) for r in sizes]).cast("array<int>")).alias("_size"))
    sized = sized.where(F.length("_name") >= F.col("_size"))
    places = F.expr("transform(sequence(1, length(_name) - _size + 1), at -> substring(_name, at, _size))")
    parts = sized.select("_name", F.explode(F.array_distinct(places)).alias("_key"))
    parts = _perhaps_keys(parts, known, sum(r["count"] for r in sizes))
    of_key = F.struct((-F.length("_key")).alias("size"), F.col("_key").alias("key"), F.col("_whole").alias("whole"), F.col("_held").alias("held"))
    ranked = parts.join(keys, "_key").groupBy("_name").agg(F.array_sort(F.collect_list(of_key)).alias("_ranked"))
    last = F.array_position(F.transform("_ranked", lambda k: k["whole"]), True)
    used = F.slice("_ranked", F.lit(1), F.when(last > 0, last).otherwise(F.size("_ranked")).cast("int"))
    slim = F.transform(F.flatten(F.transform(used, lambda k: k["held"])), lambda p: F.struct(*[p[c].alias(c) for c in ("_from", "_to", "_in", "_out")]))
    listed = materialise(ranked.select("_name", slim.alias("_prices")))
    if listed.count() <= BROADCAST_NAMES:
        listed = F.broadcast(listed)
    met = usage.join(listed, name == F.col("_name"), "left")
    if at:
        moment = col(at).cast("timestamp")
        rates = F.get(
            F.filter("_prices", lambda p: (p["_from"].isNull() | (p["_from"] <= moment)) & (p["_to"].isNull() | (moment < p["_to"])) & moment.isNotNull()),
            F.lit(0),
        )
    else:
        rates = F.get("_prices", F.lit(0))
    million = F.lit(1_000_000.0)
    cost = col(prompt).cast("double") / million * rates["_in"] + col(completion).cast("double") / million * rates["_out"]
    return met.select(*[col(c) for c in usage.columns], F.coalesce(round_half_even(cost, precision), F.lit(0.0)).alias("estimated_cost_usd"))
