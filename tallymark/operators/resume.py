"""Reusing the rows of an earlier run, so no report is paid for twice.

Matching works on keys alone. Report texts only move once, in the anti join
that leaves the reports still to be labelled.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..durable import materialise
from ..functions.text import report_hash
from .columns import ID, ORDER, canonical_id, col, fix_order, require_columns

PRIOR = "_prior_ord"
REUSE = "reuse"


@dataclass(frozen=True)
class Resume:
    """Outcome of matching reports against an earlier run.

    ``matches``: (_ord, _prior_ord, reuse), reuse being ``id`` or ``hash``.
    ``reused``: earlier rows under the report's own ID, with ``_ord`` and ``reuse``.
    ``todo``: reports left to label, with ``_ord``.
    ``stats``: one-row table of counts.
    """

    matches: DataFrame
    reused: DataFrame
    todo: DataFrame
    stats: DataFrame


def resume_match(
    reports: DataFrame,
    history: DataFrame,
    *,
    id_col: str = ID,
    text_col: str = "report_text",
    order_by: str | None = None,
    history_order: str | None = None,
    require_same_hash: bool = False,
    retry_status: Sequence[str] = (),
    cut: Callable[[DataFrame], DataFrame] = materialise,
) -> Resume:
    """Match reports with an earlier run, by ID first and by text hash second.

    * The last earlier row of an ID is reused by the first report of that ID,
      whatever its text, unless ``require_same_hash`` is set.
    * Earlier rows left over are reused by text hash, if exactly one of them
      has the hash; the first such report takes it. Reports whose hash has
      several earlier rows are labelled again and counted as collisions.
    * Rows with a status in ``retry_status`` are not reused.

    The order columns must identify a row on either side and be stable across
    reads; a side without one is written out once. ``cut`` is applied to the slim
    tables of keys and matches, which are used several times: by default they go
    to a checkpoint, so either input is read twice, and its texts are hashed once.
    """
    named = canonical_id(reports, id_col)
    require_columns(named, [ID, text_col])
    ordered = fix_order(named, order_by)
    prior = fix_order(canonical_id(history), history_order, PRIOR).drop(ORDER, REUSE)
    new = ordered.select(ORDER, col(ID).cast("string").alias(ID), report_hash(col(text_col)).alias("_hash"))
    has_status = "status" in prior.columns
    retry = col("status").isin(*retry_status) if has_status and retry_status else F.lit(False)
    has_hash = "report_hash" in prior.columns
    old = prior.select(
        PRIOR,
        col(ID).cast("string").alias(ID),
        (col("report_hash").cast("string") if has_hash else F.lit("")).alias("_hash"),
        F.coalesce(retry, F.lit(False)).alias("_retry"),
    )

    new, old = cut(new), cut(old)
    by_id = cut(_match_ids(new, old, require_same_hash))
    buckets = cut(_match_hashes(new, old, by_id))
    by_hash = buckets.where(col("_offered") == 1).select(ORDER, PRIOR, F.lit("hash").alias(REUSE), ID)
    matches = cut(by_id.unionByName(by_hash))

    carried = [col(c) for c in prior.columns if c not in (PRIOR, ID)]
    taken = matches.select(ORDER, PRIOR, REUSE, col(ID).alias("_new_id"))
    reused = prior.join(taken, PRIOR).select(
        ORDER, REUSE, F.coalesce(col("_new_id"), col(ID)).alias(ID), *carried
    )
    todo = ordered.join(matches.select(ORDER), ORDER, "left_anti")
    stats = _stats(new, old, matches, buckets)
    return Resume(matches.select(ORDER, PRIOR, REUSE), reused, todo, stats)


def _match_ids(new: DataFrame, old: DataFrame, require_same_hash: bool) -> DataFrame:
    firsts = new.where(col(ID).isNotNull() & (col(ID) != "")).groupBy(ID).agg(
        F.min(ORDER).alias(ORDER), F.min_by("_hash", ORDER).alias("_hash")
    )
    lasts = old.where(col(ID).isNotNull() & (col(ID) != "")).groupBy(ID).agg(
        F.max(PRIOR).alias(PRIOR),
        F.max_by("_hash", PRIOR).alias("_old_hash"),
        F.max_by("_retry", PRIOR).alias("_retry"),
    )
    both = firsts.join(lasts, ID).where(~col("_retry"))
    if require_same_hash:
        both = both.where(col("_hash") == col("_old_hash"))
    return both.select(ORDER, PRIOR, F.lit("id").alias(REUSE), ID)


def _match_hashes(new: DataFrame, old: DataFrame, by_id: DataFrame) -> DataFrame:
    new_left = new.where(col("_hash") != "").join(by_id.select(ORDER), ORDER, "left_anti")
    old_left = old.where((col("_hash") != "") & ~col("_retry")).join(
        by_id.select(PRIOR), PRIOR, "left_anti"
    )
    # Counted before the join, so a text shared by many rows is one row here.
    asking = new_left.groupBy("_hash").agg(
        F.min(ORDER).alias(ORDER), F.min_by(ID, ORDER).alias(ID), F.count("*").alias("_asking")
    )
    offered = old_left.groupBy("_hash").agg(F.max(PRIOR).alias(PRIOR), F.count("*").alias("_offered"))
    return asking.join(offered, "_hash")


def _stats(new: DataFrame, old: DataFrame, matches: DataFrame, buckets: DataFrame) -> DataFrame:
    """Counts, each from its own small aggregate, stacked and added up."""
    reused = matches.agg(
        F.count_if(col(REUSE) == "id").alias("matched_by_id"),
        F.count_if(col(REUSE) == "hash").alias("matched_by_hash"),
    )
    collided = buckets.agg(
        F.coalesce(F.sum(F.when(col("_offered") > 1, col("_asking"))), F.lit(0)).alias("hash_collisions")
    )
    used = matches.select(PRIOR, F.lit(True).alias("_used"))
    marked = old.join(used, PRIOR, "left")
    # An ID is spent when any of its rows was reused: by ID (its last row) or by hash.
    spent = marked.where(col(ID).isNotNull() & (col(ID) != "")).groupBy(ID).agg(F.count("_used").alias("_n"))
    ids_left = spent.agg(F.count_if(col("_n") == 0).alias("unmatched_ids"))
    hashes_left = marked.agg(
        F.count_if(col("_used").isNull() & (F.coalesce(col("_hash"), F.lit("")) != "")).alias(
            "unmatched_hash_rows"
        )
    )
    read = new.agg(F.count("*").alias("input_rows"))
    frames = [read, reused, collided, ids_left, hashes_left]
    names = [name for frame in frames for name in frame.columns]
    stacked = frames[0]
    for frame in frames[1:]:
        stacked = stacked.unionByName(frame, allowMissingColumns=True)
    totals = stacked.agg(*[F.coalesce(F.sum(name), F.lit(0)).alias(name) for name in names])
    rest = col("input_rows") - col("matched_by_id") - col("matched_by_hash")
    return totals.select("*", rest.alias("to_label"))
