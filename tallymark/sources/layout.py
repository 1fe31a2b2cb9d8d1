"""Label runs stored by ID, so that aligning them moves nothing."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.identifiers import IdRule
from ..operators.columns import ID, ORDER, binary, col, order_column, resolve_column
from ..operators.dedupe import pick_by_order

#: Buckets a stored run has; runs are joined without a shuffle if they have as many.
BUCKETS = 64


def store_run(
    df: DataFrame, name: str, path: str, labels: Sequence[str], *, buckets: int = BUCKETS, id_col: str = ID,
    rule: IdRule = IdRule(), order_by: str | None = None,
) -> DataFrame:
    """Write a run as table ``name`` at ``path``: its first row per normalised ID, bucketed and sorted by it.

    Votes are stored as integers. The one shuffle of the run is paid here, once.
    """
    values = [binary(df, resolve_column(df, label)).alias(label) for label in labels]
    slim = df.select(rule.apply(col(resolve_column(df, id_col))).alias(ID), order_column(df, order_by).alias(ORDER), *values)
    first = pick_by_order(slim, [ID], list(labels), col(ORDER)).repartition(buckets, ID)
    writer = first.write.bucketBy(buckets, ID).sortBy(ID).mode("overwrite").option("path", path)
    writer.format("parquet").saveAsTable(name)
    return df.sparkSession.table(name)


def open_run(spark: SparkSession, name: str, path: str, *, buckets: int = BUCKETS) -> DataFrame:
    """Make a run that another session stored at ``path`` known as table ``name``."""
    fields = spark.read.parquet(path).schema.fields
    columns = ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in fields)
    place = path.replace("\\", "\\\\").replace("'", "\\'")
    spark.sql(
        f"CREATE TABLE {name} ({columns}) USING parquet CLUSTERED BY (`{ID}`) SORTED BY (`{ID}`) INTO {int(buckets)} BUCKETS LOCATION '{place}'"
    )
    return spark.table(name)


def align_stored(runs: Mapping[str, DataFrame], labels: Sequence[str]) -> DataFrame:
    """``align_runs`` of runs opened from their stored tables: IDs all have, with ``<run>__<label>``; no shuffle."""
    if len(runs) < 2:
        raise ValueError("Provide at least two label runs.")
    aligned = None
    for run, df in runs.items():
        side = df.select(ID, *[F.col(f"`{label}`").alias(f"{run}__{label}") for label in labels])
        aligned = side if aligned is None else aligned.join(side.hint("merge"), ID)
    return aligned
