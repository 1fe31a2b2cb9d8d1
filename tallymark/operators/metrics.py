"""Truth-versus-prediction metrics over aligned tables.

An aligned table holds ``true_<label>`` and ``pred_<label>`` columns and
optionally a ``_weight`` that says how many row pairs a row stands for.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.coercion import parse_number, ratio, round4, round_half_even
from ..functions.identifiers import IdRule
from .align import IN_LEFT, IN_RIGHT, WEIGHT
from .columns import ID, ORDER, binary, col, order_column, resolve_column
from .votes import confusion_cells

# Names of the summary rows.
MACRO = "MACRO_AVERAGE"
MICRO = "MICRO_AVERAGE"

RATES = ("precision", "recall", "f1", "accuracy")
CELLS = ("tp", "fp", "fn", "tn")
EXACT = "_exact"


def _weight(df: DataFrame) -> Column:
    return col(WEIGHT) if WEIGHT in df.columns else F.lit(1).cast("bigint")


def _same_raw(df: DataFrame, left: str, right: str) -> Column:
    """Equality of two raw label values; null and NaN equal nothing."""
    kinds = [df.schema[name].dataType for name in (left, right)]
    text = [isinstance(kind, T.StringType) for kind in kinds]
    if not any(text):
        same = col(left) == col(right)
        for name, kind in zip((left, right), kinds):
            if isinstance(kind, (T.DoubleType, T.FloatType)):
                same = same & ~F.isnan(col(name))
        return F.coalesce(same, F.lit(False))
    numbers = [
        parse_number(col(name)) if is_text else col(name).cast("double")
        for name, is_text in zip((left, right), text)
    ]
    as_numbers = numbers[0] == numbers[1]
    as_text = col(left).cast("string") == col(right).cast("string")
    return F.coalesce(as_numbers, as_text, F.lit(False))


def pair_patterns(aligned: DataFrame, labels: Sequence[str]) -> DataFrame:
    """Coerced votes, exact-match flag and weight of every aligned row."""
    sides = [name for name in (IN_LEFT, IN_RIGHT) if name in aligned.columns]
    exact = F.lit(True)
    for label in labels:
        exact = exact & _same_raw(aligned, f"true_{label}", f"pred_{label}")
    votes = [f"{side}_{label}" for side in ("true", "pred") for label in labels]
    return aligned.select(
        *[col(name) for name in sides],
        exact.alias(EXACT),
        *[binary(aligned, name).alias(name) for name in votes],
        _weight(aligned).alias(WEIGHT),
    )


def confusion_counts(aligned: DataFrame, labels: Sequence[str]) -> DataFrame:
    """Rows (label_pos, label, tp, fp, fn, tn) from one pass over the input.

    One aggregate without keys has four sums per label; its single row is then
    laid out as one row per label.
    """
    matched = _matched(aligned)
    sums = []
    for i, x in enumerate(labels):
        cells = confusion_cells(binary(matched, f"true_{x}"), binary(matched, f"pred_{x}"), _weight(matched))
        sums += [F.coalesce(cell, F.lit(0)).cast("bigint").alias(f"_{name}{i}") for name, cell in zip(CELLS, cells)]
    per_label = [
        F.struct(F.lit(i).alias("label_pos"), F.lit(x).alias("label"), *[col(f"_{c}{i}").alias(c) for c in CELLS])
        for i, x in enumerate(labels)
    ]
    return matched.agg(*sums).select(F.inline(F.array(*per_label)))


def _matched(aligned: DataFrame) -> DataFrame:
    if IN_LEFT in aligned.columns:
        return aligned.where(col(IN_LEFT) & col(IN_RIGHT))
    return aligned


def _rates(tp: Column, fp: Column, fn: Column, tn: Column, zero_support: bool) -> dict[str, Column]:
    precision = ratio(tp, tp + fp)
    recall = ratio(tp, tp + fn)
    total = precision + recall
    f1 = F.when(total > 0, 2 * (precision * recall) / total).otherwise(F.lit(0.0))
    rates = {"precision": precision, "recall": recall, "f1": f1}
    if zero_support:
        without = F.when(fp == 0, F.lit(1.0)).otherwise(F.lit(0.0))
        rates = {k: F.when(tp + fn == 0, without).otherwise(v) for k, v in rates.items()}
    rates["accuracy"] = ratio(tp + tn, tp + fp + fn + tn)
    return {name: round4(value) for name, value in rates.items()}


def binary_metrics(counts: DataFrame) -> DataFrame:
    """Precision, recall, F1 and accuracy per label, at four places.

    A label without positives in the truth scores 1.0 when nothing was
    predicted either and 0.0 otherwise.
    """
    rates = _rates(*[col(c) for c in CELLS], zero_support=True)
    carried = [col(c) for c in counts.columns if c not in CELLS]
    return counts.select(
        *carried, *[rates[r].alias(r) for r in RATES], *[col(c) for c in CELLS]
    )


def with_averages(metrics: DataFrame, micro: bool = True, by: Sequence[str] = ()) -> DataFrame:
    """Append the macro row and, if asked, the micro row; for every group of ``by``, if given.

    Macro is the mean of the rounded per-label values. Micro comes from summed
    counts and has no zero-support rule. The per-label rows (one per label
    column) are folded into one array, so the input is computed once.
    """
    fields = ["label_pos", "label", *RATES, *CELLS]
    folded = metrics.groupBy(*[col(c) for c in by]).agg(
        F.sort_array(F.collect_list(F.struct(*[col(f) for f in fields]))).alias("rows"),
        F.count("*").cast("int").alias("labels"),
        *[round4(F.avg(r)).alias(r) for r in RATES],
        *[F.sum(c).alias(c) for c in CELLS],
    ).where(col("labels") > 0)

    def summary(position: int, name: str, rates: dict[str, Column]) -> Column:
        return F.struct(
            (col("labels") + F.lit(position)).alias("label_pos"),
            F.lit(name).alias("label"),
            *[rates[r].alias(r) for r in RATES],
            *[col(c) for c in CELLS],
        )

    extra = [summary(0, MACRO, {r: col(r) for r in RATES})]
    if micro:
        extra.append(summary(1, MICRO, _rates(*[col(c) for c in CELLS], zero_support=False)))
    return folded.select(*[col(c) for c in by], F.inline(F.concat(col("rows"), F.array(*extra))))


def compare_many(
    truth: DataFrame,
    runs: Mapping[str, DataFrame],
    labels: Sequence[str],
    *,
    id_col: str = ID,
    rule: IdRule = IdRule(),
    order_by: str | None = None,
    micro: bool = True,
) -> DataFrame:
    """``compare_metrics`` of each run against one truth, with the ``run``'s name, from a single shuffle.

    Truth and runs are stacked and reduced to the first row of every side per ID,
    so the truth is read once and nothing is joined; four sums per run and label
    over that table give all counts. As in ``align_pair``, an ID counts for the
    runs that have it, whatever other runs have.
    """
    sides = [truth, *runs.values()]
    stacked = None
    for i, df in enumerate(sides):
        values = F.struct(*[binary(df, resolve_column(df, x)).alias(f"v{j}") for j, x in enumerate(labels)])
        slim = df.select(
            rule.apply(col(resolve_column(df, id_col))).alias(ID),
            F.lit(i).alias("_side"),
            order_column(df, order_by).alias(ORDER),
            values.alias("_values"),
        )
        stacked = slim if stacked is None else stacked.unionByName(slim)
    firsts = stacked.groupBy(ID).agg(
        *[F.min_by("_values", F.when(col("_side") == i, col(ORDER))).alias(f"_s{i}") for i in range(len(sides))]
    )
    sums, laid = [], []
    for i, run in enumerate(runs, 1):
        met = col("_s0").isNotNull() & col(f"_s{i}").isNotNull()
        for j, x in enumerate(labels):
            one = F.when(met, F.lit(1).cast("bigint")).otherwise(F.lit(0).cast("bigint"))
            cells = confusion_cells(col("_s0")[f"v{j}"], col(f"_s{i}")[f"v{j}"], one)
            sums += [F.coalesce(cell, F.lit(0)).cast("bigint").alias(f"_{name}{i}_{j}") for name, cell in zip(CELLS, cells)]
            named = [F.lit(run).alias("run"), F.lit(j).alias("label_pos"), F.lit(x).alias("label")]
            laid.append(F.struct(*named, *[col(f"_{name}{i}_{j}").alias(name) for name in CELLS]))
    counts = firsts.agg(*sums).select(F.inline(F.array(*laid)))
    return with_averages(binary_metrics(counts), micro, ["run"])


def compare_by(aligned: DataFrame, labels: Sequence[str], dimensions: Sequence[str], micro: bool = True) -> DataFrame:
    """``compare_metrics`` for every combination of ``dimensions``, each alone, and overall, in one pass.

    Counts are grouped over all subsets of the dimensions (a cube) from one scan
    and one shuffle; a column that is rolled up is null and ``_level`` is the
    cube's grouping number (0: all dimensions, the largest: overall). Rows are
    combined per task first, so a dimension with one frequent value is small.
    """
    matched = _matched(aligned)
    cells, laid = [], []
    for j, x in enumerate(labels):
        found = confusion_cells(binary(matched, f"true_{x}"), binary(matched, f"pred_{x}"), _weight(matched))
        cells += [F.coalesce(cell, F.lit(0)).cast("bigint").alias(f"_{name}{j}") for name, cell in zip(CELLS, found)]
        named = [F.lit(j).alias("label_pos"), F.lit(x).alias("label")]
        laid.append(F.struct(*named, *[col(f"_{name}{j}").alias(name) for name in CELLS]))
    keys = [col(d) for d in dimensions]
    counts = matched.cube(*keys).agg(F.grouping_id().cast("int").alias("_level"), *cells)
    groups = ["_level", *dimensions]
    counts = counts.select(*[col(g) for g in groups], F.inline(F.array(*laid)))
    return with_averages(binary_metrics(counts), micro, groups)


def compare_metrics(aligned: DataFrame, labels: Sequence[str], micro: bool = True) -> DataFrame:
    """Per-label metrics plus the summary rows, in label order by ``label_pos``."""
    return with_averages(binary_metrics(confusion_counts(aligned, labels)), micro)


def discrepancies(
    aligned: DataFrame, labels: Sequence[str], report_column: str | None = None
) -> DataFrame:
    """One row per ID and label whose coerced prediction differs from the truth.

    A table with weights gives a ``Count`` of the row pairs such a row stands for.
    """
    matched = _matched(aligned)
    cells = F.array(
        *[
            F.struct(
                F.lit(label).alias("Label"),
                binary(matched, f"pred_{label}").alias("Predicted"),
                binary(matched, f"true_{label}").alias("Actual"),
            )
            for label in labels
        ]
    )
    wrong = F.filter(cells, lambda cell: cell["Predicted"] != cell["Actual"])
    kept = [col(ID)]
    if report_column is not None:
        kept.append(col(report_column).alias("Report"))
    counted = [col(WEIGHT).alias("Count")] if WEIGHT in matched.columns else []
    listed = matched.select(*kept, *counted, F.inline(wrong))
    return listed.select(*_discrepancy_columns(report_column), *["Count"] * len(counted))


def _discrepancy_columns(report_column: str | None) -> list[str]:
    names = [ID, "Label", "Predicted", "Actual"]
    return names if report_column is None else [*names, "Report"]


def compare_summary(
    table: DataFrame,
    labels: Sequence[str],
    left_name: str = "left",
    right_name: str = "right",
    unmatched: DataFrame | None = None,
) -> DataFrame:
    """One-row summary of a comparison.

    ``table`` is a pair table, an aligned table or the patterns of either. The
    one-sided ID counts come from the pair flags, or from ``unmatched`` when
    the table only holds matched rows.
    """
    patterns = table if EXACT in table.columns else pair_patterns(table, labels)
    n = col(WEIGHT)
    flagged = IN_LEFT in patterns.columns
    both = col(IN_LEFT) & col(IN_RIGHT) if flagged else F.lit(True)
    correct = sum(
        (F.when(col(f"true_{x}") == col(f"pred_{x}"), F.lit(1)).otherwise(F.lit(0)) for x in labels),
        F.lit(0),
    )

    def total(condition: Column, value: Column = n) -> Column:
        return F.coalesce(F.sum(F.when(condition, value)), F.lit(0)).cast("bigint")

    only = {left_name: F.lit(None).cast("bigint"), right_name: F.lit(None).cast("bigint")}
    if flagged:
        only = {left_name: total(~col(IN_RIGHT)), right_name: total(~col(IN_LEFT))}
    counted = patterns.agg(
        total(both).alias("matched_reports"),
        *[value.alias(f"{name}_only") for name, value in only.items()],
        total(both, n * correct).alias("total_correct_labels"),
        total(both & col(EXACT)).alias("exact_match_count"),
    )
    if not flagged and unmatched is not None:
        sides = unmatched.agg(
            F.count_if(col("side") == "left_only").alias(f"{left_name}_only"),
            F.count_if(col("side") == "right_only").alias(f"{right_name}_only"),
        )
        counted = merge_single_rows([counted, sides])
    matched = col("matched_reports")
    return counted.select(
        matched.alias("total_reports"),
        matched,
        col(f"{left_name}_only"),
        col(f"{right_name}_only"),
        F.array(*[F.lit(x) for x in labels]).alias("labels_compared"),
        (matched * len(labels)).alias("total_labels"),
        col("total_correct_labels"),
        round4(ratio(col("total_correct_labels"), matched * len(labels))).alias("label_accuracy"),
        col("exact_match_count"),
        round4(ratio(col("exact_match_count"), matched)).alias("exact_match_rate"),
    )


def merge_single_rows(frames: Sequence[DataFrame]) -> DataFrame:
    """Join one-row tables side by side (by union, which needs no join key)."""
    stacked = frames[0]
    for frame in frames[1:]:
        stacked = stacked.unionByName(frame, allowMissingColumns=True)
    return stacked.agg(*[F.max(col(name)).alias(name) for name in stacked.columns])


def evaluation_summary(
    rows: DataFrame, metrics: DataFrame, model: str, cost_column: str = "estimated_cost_usd"
) -> DataFrame:
    """One-row summary of a prompt evaluation: cost, latency, coverage, macro scores."""

    def having(status: str) -> Column:
        return F.count_if(col("status") == status)

    counted = rows.agg(
        F.coalesce(round_half_even(F.sum(cost_column), 6), F.lit(0.0)).alias("total_estimated_cost_usd"),
        F.coalesce(round4(F.avg("latency_seconds")), F.lit(0.0)).alias("average_latency_seconds"),
        F.count("*").alias("total_reports"),
        having("success").alias("labeled_reports"),
        having("skipped").alias("skipped_reports"),
        having("error").alias("error_reports"),
    ).withColumn(
        "coverage_percent",
        round_half_even(ratio(col("labeled_reports"), col("total_reports")) * 100.0, 2),
    )
    macro = metrics.where(col("label") == MACRO).select(
        col("f1").alias("macro_f1"),
        col("precision").alias("macro_precision"),
        col("recall").alias("macro_recall"),
    )
    merged = merge_single_rows([counted, macro])
    names = list(counted.columns)
    return merged.select(
        *names, F.lit(model).alias("model_version"), "macro_f1", "macro_precision", "macro_recall"
    )


def run_totals(rows: DataFrame, resumed: Column | None = None, cost_precision: int = 8) -> DataFrame:
    """One-row totals of a label run; latency and attempts skip unlabelled rows."""
    status = F.when(F.coalesce(col("status"), F.lit("")) == "", F.lit("unknown")).otherwise(col("status"))
    asked = status != "skipped"

    def mean(name: str) -> Column:
        return F.coalesce(F.avg(F.when(asked, col(name))), F.lit(0.0))

    def total(name: str) -> Column:
        return F.coalesce(F.sum(name), F.lit(0))

    return rows.agg(
        F.count("*").alias("total_reports"),
        F.count_if(F.lit(False) if resumed is None else resumed).alias("resumed_reports"),
        total("prompt_tokens").alias("prompt_tokens"),
        total("completion_tokens").alias("completion_tokens"),
        F.coalesce(round_half_even(F.sum("estimated_cost_usd"), cost_precision), F.lit(0.0)).alias("total_cost_usd"),
        mean("latency_seconds").alias("average_latency_seconds"),
        mean("retry_count").alias("average_attempts"),
        F.count_if(status == "success").alias("success"),
        F.count_if(status == "error").alias("error"),
        F.count_if(status == "skipped").alias("skipped"),
        F.count_if(~status.isin("success", "error", "skipped")).alias("other"),
    )


__all__ = [
    "MACRO",
    "MICRO",
    "binary_metrics",
    "compare_metrics",
    "compare_summary",
    "confusion_counts",
    "discrepancies",
    "evaluation_summary",
    "merge_single_rows",
    "pair_patterns",
    "run_totals",
    "with_averages",
]
