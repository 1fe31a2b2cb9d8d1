"""Line dedup: drop lines that several documents share, but for their first holder."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WHITE, lowered


def split_lines(text: Column) -> Column:
    """Lines of a text; a null or empty text is one empty line."""
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_keys(text: Column, min_chars: int) -> Column:
    """One key per line: MD5 of the stripped, lower-cased line; null for short lines."""

    def key(line: Column) -> Column:
        bare = F.btrim(line, F.lit(WHITE))
        return F.when(F.char_length(bare) >= min_chars, F.md5(bare.cast("binary")))

    return F.transform(split_lines(lowered(text)), key)


def drop_shared_lines(
    docs: DataFrame,
    max_docs: int = 1,
    min_chars: int = 10,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Remove every line that more than ``max_docs`` documents hold.

    Lines are exploded as MD5 keys of the normalised line, documents counted per
    key, and lines of keys over the threshold marked for removal in all
    documents but the one with the smallest id. Only keys, ids and positions
    move for that; each text moves once, to meet its list of positions, and is
    put together again by position.

    Returns one row per input row: ``row`` (struct of all input columns),
    ``kept`` (the remaining lines joined by \\n), ``n_lines``, ``n_dropped``.

    A key's lines are counted once per row, so a key of half of all rows is one
    row per task before it is shuffled. A null or empty text is one empty line,
    which has no key and stays. A null id counts as a document but is never the
    smallest: it loses lines that a document with an id holds, and keeps lines
    that only null ids hold. Repeated rows keep and lose the same lines. An empty
    table gives an empty result.
    """
    text, doc_id = F.col(f"`{text_col}`"), F.col(f"`{id_col}`")
    held = docs.select(doc_id.alias("id"), F.xxhash64(text).alias("check"), line_keys(text, min_chars).alias("keys"))
    shared = (
        held.select("id", F.explode(F.array_distinct("keys")).alias("key"))
        .where("key is not null")
        .groupBy("key")
        .agg(F.count("*").alias("docs"), F.min("id").alias("first"))
        .where((F.col("docs") > max_docs) & F.col("first").isNotNull())
        .select("key", "first")
    )
    marked = held.select("id", "check", F.posexplode("keys").alias("pos", "key")).where("key is not null")
    gone = (
        marked.join(shared, "key")
        .where(F.col("id").isNull() | (F.col("id") > F.col("first")))
        .groupBy("id", "check")
        .agg(F.array_sort(F.collect_set("pos")).alias("gone"))
        .select(F.col("id").alias("gone_id"), F.col("check").alias("gone_check"), "gone")
    )
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
        doc_id.alias("id"),
        F.xxhash64(text).alias("check"),
    )
    met = rows.join(gone, F.col("id").eqNullSafe(F.col("gone_id")) & (F.col("check") == F.col("gone_check")), "left")
    lines = split_lines(F.col(f"row.`{text_col}`"))
    met = met.select("row", lines.alias("lines"), F.coalesce("gone", F.array().cast("array<int>")).alias("gone"))
    # The stretches between removed positions; linear in the number of lines.
    kept = F.expr(
        "flatten(transform(concat(array(-1), gone), (p, i) -> "
        "slice(lines, p + 2, coalesce(get(gone, i), size(lines)) - p - 1)))"
    )
    return met.select(
        "row",
        F.when(F.size("gone") == 0, F.coalesce(F.col(f"row.`{text_col}`"), F.lit("")))
        .otherwise(F.array_join(kept, "\n"))
        .alias("kept"),
        F.size("lines").cast("long").alias("n_lines"),
        F.size("gone").cast("long").alias("n_dropped"),
    )
