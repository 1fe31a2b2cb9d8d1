"""Label a report table, reusing an earlier run where it can be."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable
from typing import Any
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..durable import materialise, path_exists, publish, read_small, remove
from ..functions.costs import Pricing
from ..functions.prompts import PromptSpec
from ..operators.columns import ORDER, col, fix_order, normalize_run_rows, run_columns
from ..operators.labeling import ModelFactory, label_reports
from ..operators.metrics import run_totals
from ..operators.resume import resume_match
from .results import LabelRun

SLICE = "slice"
# What the slices belong to, and a mark for each that is finished; readers of the output skip both.
MANIFEST, SLICE_LEDGER = "_manifest", "_slices"
# Options that change how calls are made, but not what is asked.
_HOW = {"max_retries", "retry_on", "wait_seconds", "partitions", "side_by_side"}


def resume_batch(
    reports: DataFrame,
    history: DataFrame,
    prompt: PromptSpec,
    model_factory: ModelFactory,
    *,
    cost_precision: int = 8,
    matching: dict[str, Any] | None = None,
    **options: Any,
) -> tuple[DataFrame, DataFrame]:
    """Reused and newly labelled rows of one batch, with ``_ord`` and ``reuse``.

    Returned with the one-row table of match counts. ``matching`` goes to
    ``resume_match`` and ``options`` to ``label_reports``.
    """
    match = resume_match(reports, history, **(matching or {}))
    fresh = label_reports(
        match.todo, prompt, model_factory, cost_precision=cost_precision, keep_order=True, **options
    )
    reused = normalize_run_rows(match.reused, prompt.labels, cost_precision, [ORDER, "reuse"])
    return reused.unionByName(fresh.withColumn("reuse", F.lit("none"))), match.stats


def generate_labels(
    reports: DataFrame,
    prompt: PromptSpec,
    model_factory: ModelFactory,
    *,
    model: str = "",
    pricing: Pricing | None = None,
    cost_precision: int = 8,
    history: DataFrame | None = None,
    output: str | None = None,
    slices: int = 1,
    on_change: str = "refuse",
    matching: dict[str, Any] | None = None,
    **options: Any,
) -> LabelRun:
    """Label all reports and sum up the run.

    Every row is computed once: into ``output`` or into a checkpoint. Rows of
    ``history`` that match no report are not carried over. ``output`` must not
    be the folder ``history`` is read from.

    With ``slices`` > 1 the rows are labelled and committed to ``output`` in that
    many parts, dealt by a hash of report ID and text. A part that was finished
    is not labelled again when the same call is repeated after a crash, so a
    crash costs the calls of one part. Rows that hold ID and text alike go to
    one part; reports are read once for each part, and once before the first.

    A manifest in ``output`` names what its parts belong to: the number of slices
    and digests of prompt, labels, model, pricing, reports and reused rows. It is
    published whole before the first part. A call that differs from it is
    refused with ``ValueError``, or with ``on_change="restart"`` the parts are
    removed and labelled anew. How calls are made (retries, tasks) may change.
    """
    if on_change not in ("refuse", "restart"):
        raise ValueError(f"on_change is 'refuse' or 'restart', not {on_change!r}.")
    if output is not None and history is not None:
        _refuse_same_folder(history, output)
    if slices > 1 and output is None:
        raise ValueError("Slices are committed to output; name one.")
    ordered = fix_order(reports, (matching or {}).get("order_by"))
    settings = {"model": model, "pricing": pricing, "cost_precision": cost_precision, **options}
    if history is None:
        todo, reused, stats = ordered, None, None
    else:
        match = resume_match(ordered, history, **{**(matching or {}), "order_by": ORDER})
        todo, stats = match.todo, match.stats
        reused = normalize_run_rows(match.reused, prompt.labels, cost_precision)
    columns = [col(c) for c in run_columns(prompt.labels)]

    def labelled(part: DataFrame) -> DataFrame:
        return label_reports(part, prompt, model_factory, **settings).select(*columns)

    if slices <= 1:
        rows = labelled(todo)
        done = materialise(rows if reused is None else reused.select(*columns).unionByName(rows), output)
    else:
        asked = {"prompt": repr(prompt), "model": model, "pricing": repr(pricing), "cost_precision": cost_precision}
        asked |= {"options": repr(sorted((k, v) for k, v in options.items() if k not in _HOW))}
        done = _commit_slices(todo, labelled, reused, output, slices, asked, on_change == "restart").select(*columns)
    totals = run_totals(done, cost_precision=cost_precision)
    if stats is not None:
        reused = stats.select(col("matched_by_id") + col("matched_by_hash")).scalar()
        totals = totals.withColumn("resumed_reports", reused)
    return LabelRun(done, totals, stats)


def _refuse_same_folder(history: DataFrame, output: str) -> None:
    """Raise if ``history`` is read from ``output``, which is about to be replaced."""

    def bare(path: str) -> str:
        return re.sub(r"^\w+:/*", "/", unquote(path)).rstrip("/") + "/"

    if any(bare(file).startswith(bare(output)) for file in history.inputFiles()):
        raise ValueError(f"history is read from the output folder {output!r}; write the run elsewhere.")


def _commit_slices(
    todo: DataFrame,
    labelled: Callable[[DataFrame], DataFrame],
    reused: DataFrame | None,
    output: str,
    slices: int,
    asked: dict[str, Any],
    restart: bool,
) -> DataFrame:
    """Label and write one slice after the other, then mark it as finished."""
    spark = todo.sparkSession
    names = {c.lower(): c for c in todo.columns}
    identity = [col(names[c]).cast("string") for c in ("volumename", "report_text") if c in names]
    asked = {
        "slices": slices,
        **{name: hashlib.sha256(str(value).encode()).hexdigest() for name, value in asked.items()},
        "reports": _content(todo.select(*identity)),
        "reused": None if reused is None else _content(reused),
    }
    _claim(spark, output, asked, restart)
    slice_of = F.pmod(F.xxhash64(*identity), F.lit(slices))
    parts = range(slices + (reused is not None))
    for number in parts:
        if path_exists(spark, f"{output}/{SLICE_LEDGER}/{number}"):
            continue
        part = labelled(todo.where(slice_of == number)) if number < slices else reused
        part.write.mode("overwrite").parquet(f"{output}/{SLICE}={number}")
        publish(spark, f"{output}/{SLICE_LEDGER}/{number}", "")
    return spark.read.option("basePath", output).parquet(*[f"{output}/{SLICE}={number}" for number in parts])


def _content(rows: DataFrame) -> str:
    """Digest of a table's rows, whatever their order: their number and two sums of hashes."""
    cells = [col(c) for c in rows.columns]
    first, second = F.xxhash64(*cells), F.xxhash64(F.lit(1), *cells)
    found = rows.agg(F.count("*"), F.sum(first.cast("decimal(20,0)")), F.sum(second.cast("decimal(20,0)"))).first()
    return "/".join(str(value) for value in found)


def _claim(spark: SparkSession, output: str, asked: dict[str, Any], restart: bool) -> None:
    """Make ``output`` the place of this call, or raise if it holds another one's parts."""
    found = read_small(spark, f"{output}/{MANIFEST}")
    before = json.loads(found) if found is not None else None
    if before == asked:
        return
    if before is None and not path_exists(spark, output):
        publish(spark, f"{output}/{MANIFEST}", json.dumps(asked))
        return
    if not restart and before is not None:
        changed = sorted(k for k in asked.keys() | before.keys() if asked.get(k) != before.get(k))
        raise ValueError(f"{output!r} holds slices of another call; changed: {', '.join(changed)}.")
    if not restart and _holds_rows(spark, output):
        raise ValueError(f"{output!r} holds rows but no manifest; name another folder or restart.")
    # Without a manifest the rest is refused, so a crash in between loses and mixes nothing.
    remove(spark, f"{output}/{MANIFEST}")
    remove(spark, f"{output}/{SLICE_LEDGER}")
    remove(spark, output)
    publish(spark, f"{output}/{MANIFEST}", json.dumps(asked))


def _holds_rows(spark: SparkSession, folder: str) -> bool:
    """Whether readers of a folder find files in it."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(folder)
    listed = hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(hadoop)
    return any(not status.getPath().getName().startswith(("_", ".")) for status in listed)
