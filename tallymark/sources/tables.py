"""Reading report, label and metric tables."""

from __future__ import annotations

import re
from collections.abc import Sequence
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..durable import materialise
from ..operators.columns import ORDER, col

# Cell texts that stand for a missing value.
NA_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)

_CSV = {"header": "true", "multiLine": "true", "quote": '"', "escape": '"'}


def _placed(rows: DataFrame, sizes: DataFrame, names: Sequence[str], order: Sequence[str]) -> DataFrame:
    """``names`` and the gapless row number ``_ord``: files in order, then rows of a file.

    ``rows`` has ``_file`` and ``_at``; ``sizes`` the rows and the first ``_at`` of
    every file, a table as long as the list of files.
    """
    before = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(
        col("_file").alias("_of"),
        (F.coalesce(F.sum("_rows").over(before), F.lit(0)) - col("_first")).alias("_start"),
    )
    placed = rows.join(starts, col("_file") == col("_of"))
    return placed.select(*[col(n) for n in names], (col("_start") + col("_at")).alias(ORDER))


def _cells(raw: DataFrame, columns: Sequence[str] | None = None) -> list[Column]:
    """CSV columns whose cells that mean "missing" are null."""
    names = list(columns) if columns is not None else raw.columns
    return [F.when(~col(n).isin(*NA_TOKENS), col(n)).alias(n) for n in names]


def read_reports(spark: SparkSession, path: str, columns: Sequence[str] | None = None) -> DataFrame:
    """CSV file with a header as text columns, plus the row order ``_ord``.

    Quoted fields may span lines and hold doubled quotes. Cells that mean
    "missing" become null. A file with quoted line breaks cannot be split, so
    keep large tables as Parquet (``read_table``). Rows of a CSV file have no
    number of their own, so the table is written out once with its row order:
    files by path, rows as they stand.
    """
    raw = spark.read.options(**_CSV).csv(path)
    names = list(columns) if columns is not None else raw.columns
    here = [F.col("_metadata.file_path").alias("_file"), F.monotonically_increasing_id().alias("_at")]
    rows = materialise(raw.select(*_cells(raw, names), *here))
    sizes = rows.groupBy("_file").agg(F.count("*").alias("_rows"), F.min("_at").alias("_first"))
    return _placed(rows, sizes, names, ["_file"])


def read_table(
    spark: SparkSession, path: str, columns: Sequence[str] | None = None, order_files: str | None = None
) -> DataFrame:
    """Parquet table plus the row order ``_ord``; only ``columns`` are read.

    Rows are numbered without gaps, by the path of their file and their place in
    it, so the number of a row is the same in every read and does not depend on
    how files are packed into tasks. Row counts come from the files' footers.
    ``order_files`` names a partition column that goes before the path.
    """
    df = spark.read.parquet(path)
    names = list(columns) if columns is not None else df.columns
    file = F.col("_metadata.file_path").alias("_file")
    rows = df.select(*[col(n) for n in names], file, F.col("_metadata.row_index").alias("_at"))
    first = [col(order_files).alias("_part")] if order_files else []
    sizes = df.select(*first, file).groupBy(*["_part"] * bool(first), "_file").agg(F.count("*").alias("_rows"))
    return _placed(rows, sizes.withColumn("_first", F.lit(0)), names, [*["_part"] * bool(first), "_file"])


def list_files(spark: SparkSession, pattern: str) -> list[str]:
    """Paths a glob matches; ``**`` looks through all folders below.

    Only paths come to the driver, never contents.
    """
    reader = spark.read.format("binaryFile")
    whole = _as_regex(pattern) if "**" in pattern else None
    if "**" in pattern:
        root, _, rest = pattern.partition("**")
        reader = reader.option("recursiveFileLookup", "true")
        reader = reader.option("pathGlobFilter", rest.rsplit("/", 1)[-1] or "*")
        pattern = root or "."
    listed = reader.load(pattern).select("path")
    paths = sorted(unquote(row["path"]) for row in listed.collect())
    return [path for path in paths if whole is None or whole.search(path)]


def _as_regex(pattern: str) -> re.Pattern:
    """A glob as a regular expression for the end of a path; ``**`` is any number of folders."""
    bare = re.sub(r"^\w+:", "", pattern).lstrip("/")
    parts = []
    for piece in re.split(r"(\*\*/|\*\*|\*|\?|\[[^\]]*\])", bare):
        known = {"**/": "(?:.*/)?", "**": ".*", "*": "[^/]*", "?": "[^/]"}
        parts.append(known.get(piece) or (piece if piece.startswith("[") else re.escape(piece)))
    return re.compile(f"(?:^|/){''.join(parts)}$")


def read_metrics(
    spark: SparkSession, paths: Sequence[str] = (), glob: str | None = None
) -> DataFrame:
    """Stack metric CSV files by column name; ``_source`` tells the file.

    Every file has its own header, so files are read one by one and united by
    name; a positional read of all would mix up columns in another order.
    """
    files = set(paths)
    if glob:
        files.update(list_files(spark, glob))
    if not files:
        raise ValueError("Provide at least one input file by paths or glob.")
    stacked = None
    for path in sorted(files):
        raw = spark.read.options(**_CSV).csv(path)
        part = raw.select(*_cells(raw), F.lit(path).alias("_source"))
        stacked = part if stacked is None else stacked.unionByName(part, allowMissingColumns=True)
    return stacked
