"""Few-shot example blocks, ready to paste into a prompt configuration."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.coercion import strip_space
from .columns import ID, ORDER, binary, col
from .sampling import sample_hash

# Line boundaries of a text, and the layout of a block.
_LINE_BREAK = r"\r\n|[\n\r\x{0b}\x{0c}\x{1c}\x{1d}\x{1e}\x{85}\x{2028}\x{2029}]"
_INDENT = "      "
_REPORT = "  - report: |\n"
_OUTPUT = "    output: "


def take_positions(
    df: DataFrame, positions: Sequence[int], position_by: str = ORDER
) -> DataFrame:
    """Rows at the given positions, in the order asked for (column ``rank``).

    ``position_by`` holds the 0-based position of a row. Positions the table
    does not have are left out; a position asked for twice comes twice.
    """
    spark = df.sparkSession
    wanted = [(rank, int(position)) for rank, position in enumerate(positions)]
    listed = spark.createDataFrame(wanted, "rank int, _position bigint")
    return df.join(listed, col(position_by) == col("_position")).drop("_position")


def example_block(df: DataFrame, labels: Sequence[str], text: str = "report_text") -> Column:
    """YAML block of one row: indented report lines and a one-line JSON output."""
    report = strip_space(F.coalesce(col(text), F.lit("")))
    indented = F.concat(F.lit(_INDENT), F.regexp_replace(report, _LINE_BREAK, "\n" + _INDENT), F.lit("\n"))
    lines = F.when(report == "", F.lit("")).otherwise(indented)
    pieces: list[Column] = []
    for position, label in enumerate(labels):
        lead = "{" if position == 0 else ", "
        value = binary(df, label) if label in df.columns else F.lit(0)
        pieces += [F.lit(f"{lead}{json.dumps(label)}: "), value.cast("string")]
    output = F.concat(*pieces, F.lit("}")) if pieces else F.lit("{}")
    return F.concat(F.lit(_REPORT), lines, F.lit(_OUTPUT), output, F.lit("\n"))


def format_examples(
    df: DataFrame,
    labels: Sequence[str],
    positions: Sequence[int] | None = None,
    n: int = 3,
    seed: int = 42,
    key: str = ID,
    position_by: str = ORDER,
) -> DataFrame:
    """Blocks (rank, VolumeName, block) of chosen rows, or of ``n`` random ones."""
    if positions:
        chosen = take_positions(df, positions, position_by)
    else:
        needed = [c for c in dict.fromkeys((key, ID, "report_text", *labels)) if c in df.columns]
        few = df.select(*[col(c) for c in needed], sample_hash(df, key, seed).alias("_hash"))
        # A top n; the rank then runs over these n rows, one after the other.
        few = few.orderBy("_hash", col(key)).limit(n)
        rank = F.row_number().over(Window.orderBy("_hash", col(key))) - 1
        chosen = few.withColumn("rank", rank)
    return chosen.select("rank", col(ID), example_block(chosen, labels).alias("block"))


__all__ = ["example_block", "format_examples", "take_positions"]
