"""Labelling reports as they arrive."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.prompts import PromptSpec
from ..operators.columns import ORDER, col, run_columns
from ..operators.labeling import ModelFactory, label_reports
from ..plans.label import resume_batch
from ..sources.tables import read_table
from ..durable import materialise, path_exists

BATCH = "batch_id"
# Finished batches are listed here; readers of the output skip underscore folders.
LEDGER = "_batches"


def incremental_label(
    reports: DataFrame,
    output: str,
    checkpoint: str,
    prompt: PromptSpec,
    model_factory: ModelFactory,
    *,
    order_by: str | None = None,
    trigger: dict[str, Any] | None = None,
    matching: dict[str, Any] | None = None,
    **options: Any,
) -> StreamingQuery:
    """Start a stream that labels each new report once and appends it to ``output``.

    Every micro-batch is matched against the output so far and only reports
    without a match reach the model. A batch is one partition of the output
    (``batch_id=<n>``): a replayed batch that was finished is left alone, an
    unfinished one is written again, so rows never double. What a crash can
    repeat is the calls of one batch; bound it with the source's
    ``maxFilesPerTrigger``. Batch numbers come from ``checkpoint``, so an
    output belongs to one checkpoint.

    ``order_by`` names a unique, stable column; without one the batch is
    written out once to fix the order of its rows.

    A report with an ID already in the output is dropped; one with a known text
    under a new ID gets the known labels without a call.
    """

    def label_batch(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        if _finished(spark, output, batch_id):
            return
        done = _earlier(spark, output, batch_id)
        ordered = _ordered(batch, order_by)
        if done is None:
            rows = label_reports(ordered, prompt, model_factory, keep_order=True, **options)
            rows = rows.withColumn("reuse", F.lit("none"))
        else:
            chosen = {**(matching or {}), "order_by": ORDER, "history_order": ORDER}
            rows, _ = resume_batch(ordered, done, prompt, model_factory, matching=chosen, **options)
        new = rows.where(col("reuse") != "id").select(*[col(c) for c in run_columns(prompt.labels)])
        new.write.mode("overwrite").parquet(f"{output}/{BATCH}={batch_id}")
        ledger = spark.createDataFrame([(batch_id,)], f"{BATCH} bigint")
        ledger.coalesce(1).write.mode("append").parquet(f"{output}/{LEDGER}")

    writer = reports.writeStream.foreachBatch(label_batch).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def _ordered(batch: DataFrame, order_by: str | None) -> DataFrame:
    if order_by is not None:
        return batch.withColumn(ORDER, col(order_by).cast("bigint"))
    return materialise(batch.withColumn(ORDER, F.monotonically_increasing_id()))


def _finished(spark: SparkSession, output: str, batch_id: int) -> bool:
    if not path_exists(spark, f"{output}/{LEDGER}"):
        return False
    ledger = spark.read.parquet(f"{output}/{LEDGER}")
    return not ledger.where(col(BATCH) == batch_id).isEmpty()


def _earlier(spark: SparkSession, output: str, batch_id: int) -> DataFrame | None:
    """Rows of earlier batches in arrival order, None before the first batch.

    Rows are numbered by batch, file and place in the file, so every read agrees.
    """
    if not path_exists(spark, f"{output}/{LEDGER}"):
        return None
    rows = read_table(spark, output, order_files=BATCH)
    return rows.where(col(BATCH) < batch_id)
