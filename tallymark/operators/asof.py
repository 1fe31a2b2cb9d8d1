"""As-of join: the last state of a key at or before a time."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .columns import col, require_columns

#: Ranges of time, about, that a key's rows are dealt to.
RANGES = 64


def _moment(rows: DataFrame, name: str) -> Column:
    """A time or number as a number to order by."""
    kind = rows.schema[name].dataType
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return F.unix_micros(col(name).cast("timestamp"))
    if isinstance(kind, T.NumericType):
        return col(name)
    raise ValueError(f"{name} must hold times or numbers, not {kind.simpleString()}.")


def _range_of(moment: Column, bounds: Sequence[float]) -> Column:
    """Number of bounds at or below a moment, by halving."""
    if not bounds:
        return F.lit(0)
    middle = len(bounds) // 2
    below = _range_of(moment, bounds[:middle])
    return F.when(moment < F.lit(bounds[middle]), below).otherwise(_range_of(moment, bounds[middle + 1 :]) + middle + 1)


def asof_join(
    calls: DataFrame, states: DataFrame, key: str, at: str, values: Sequence[str], *, state_at: str | None = None, ranges: int = RANGES
) -> DataFrame:
    """Every row of ``calls`` with the ``values`` of the last state of its ``key`` at or before its time ``at``.

    Both tables are stacked and dealt by key and range of time, ranges holding
    about as many rows each; within a range the last state is carried over by a
    window, and into a range the last state of the ranges before it, found on a
    table with a row per key and range. A key with most of the rows is dealt to
    as many tasks as there are ranges. Rows of ``calls`` that are alike in key and
    time meet in one task.

    Of states alike in key and time the one with the largest ``values``, compared
    in order, holds. Calls with a null key or time, or before the first state,
    get nulls; states with a null key or time are left out. Columns of calls come
    out as they went in, then ``values``, which must not be among them.
    """
    state_at = state_at or at
    require_columns(calls, [key, at])
    require_columns(states, [key, state_at, *values])
    clash = [v for v in values if v in calls.columns]
    if clash:
        raise ValueError(f"calls already have {', '.join(clash)}.")
    row = F.struct(*[col(c) for c in calls.columns])
    asked = calls.select(col(key).alias("_key"), _moment(calls, at).alias("_moment"), row.alias("_row"))
    held = states.select(col(key).alias("_key"), _moment(states, state_at).alias("_moment"), F.struct(*[col(v) for v in values]).alias("_held"))
    held = held.where("_key is not null and _moment is not null").groupBy("_key", "_moment").agg(F.max("_held").alias("_held"))
    blank = F.col("_key").isNull() | F.col("_moment").isNull()
    both = asked.where(~blank).unionByName(held, allowMissingColumns=True)
    places = [i / ranges for i in range(1, ranges)]
    found = both.agg(F.percentile_approx("_moment", places, 1000)).first()[0]  # one number per range
    span = _range_of(F.col("_moment"), sorted(set(found or [])))
    both = both.withColumn("_range", span)

    # A state comes before a call of the same time.
    inside = Window.partitionBy("_key", "_range").orderBy("_moment", F.col("_row").isNotNull())
    inside = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    carried = both.withColumn("_last", F.last("_held", ignorenulls=True).over(inside)).where("_row is not null")
    ends = held.withColumn("_range", span).groupBy("_key", "_range").agg(F.max_by("_held", "_moment").alias("_end"))
    keyed = carried.select("_key", "_range").distinct().select("*", F.lit(None).cast(ends.schema["_end"].dataType).alias("_end"), F.lit(True).alias("_asks"))
    steps = ends.withColumn("_asks", F.lit(False)).unionByName(keyed)
    earlier = Window.partitionBy("_key").orderBy("_range").rangeBetween(Window.unboundedPreceding, -1)
    steps = steps.withColumn("_before", F.last("_end", ignorenulls=True).over(earlier)).where("_asks and _before is not null")
    met = carried.join(steps.select("_key", "_range", "_before"), ["_key", "_range"], "left")
    known = met.select("_row", F.coalesce("_last", "_before").alias("_last"))
    unknown = asked.where(blank).select("_row", F.lit(None).cast(known.schema["_last"].dataType).alias("_last"))
    return known.unionByName(unknown).select("_row.*", *[F.col(f"_last.`{v}`").alias(v) for v in values])
