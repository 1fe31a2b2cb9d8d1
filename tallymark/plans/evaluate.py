"""Label a table that has ground truth and score the prompt."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.costs import Pricing, estimate_cost, total_tokens
from ..functions.prompts import PromptSpec
from ..operators.columns import (
    ID,
    ORDER,
    RUN_METADATA,
    binary,
    canonical_id,
    col,
    fix_order,
    require_columns,
    resolve_column,
)
from ..operators.labeling import ModelFactory, label_reports
from ..operators.metrics import (
    binary_metrics,
    confusion_counts,
    discrepancies,
    evaluation_summary,
    with_averages,
)
from ..durable import materialise
from .label import resume_batch
from .results import Evaluation


def evaluate_prompt(
    reports: DataFrame,
    prompt: PromptSpec,
    model_factory: ModelFactory,
    *,
    model: str = "",
    pricing: Pricing | None = None,
    history: DataFrame | None = None,
    order_by: str | None = None,
    output: str | None = None,
    **options: Any,
) -> Evaluation:
    """Predictions, per-label metrics with a macro row, discrepancies and a summary.

    ``history`` is an earlier predictions table (``pred_<label>`` columns).
    Cost is worked out from the tokens of every row, reused ones included.
    """
    require_columns(reports, prompt.labels)
    named = canonical_id(reports)
    named = named.withColumnRenamed(resolve_column(named, "report_text", "first"), "report_text")
    ordered = fix_order(named, order_by)
    asked = ordered.select(ORDER, ID, "report_text")
    settings = {"model": model, "pricing": pricing, **options}
    if history is None:
        rows = label_reports(asked, prompt, model_factory, keep_order=True, **settings)
    else:
        prior = history
        for label in prompt.labels:
            if f"pred_{label}" in prior.columns:
                prior = prior.withColumnRenamed(f"pred_{label}", label)
        rows, _ = resume_batch(asked, prior, prompt, model_factory, matching={"order_by": ORDER}, **settings)
    counted = total_tokens(col("total_tokens"), col("prompt_tokens"), col("completion_tokens"))
    cost = estimate_cost(F.lit(model), col("prompt_tokens"), col("completion_tokens"), pricing)
    metadata = {name: col(name) for name in RUN_METADATA}
    metadata |= {"total_tokens": counted, "estimated_cost_usd": cost}
    predicted = rows.select(
        ORDER,
        ID,
        *[value.alias(name) for name, value in metadata.items()],
        *[col(label).alias(f"pred_{label}") for label in prompt.labels],
    )
    done = materialise(predicted, output)
    truth = ordered.select(ORDER, *[binary(ordered, x).alias(f"true_{x}") for x in prompt.labels])
    aligned = done.select(ORDER, ID, *[f"`pred_{x}`" for x in prompt.labels]).join(truth, ORDER)
    metrics = materialise(
        with_averages(binary_metrics(confusion_counts(aligned, prompt.labels)), micro=False)
    )
    # Only the wrong rows fetch their text.
    wrong = discrepancies(aligned, prompt.labels, report_column=ORDER)
    texts = ordered.select(col(ORDER).alias("Report"), col("report_text").alias("_text"))
    wrong = wrong.join(texts, "Report").select(
        ID, "Label", "Predicted", "Actual", col("_text").alias("Report")
    )
    published = [c for c in done.columns if c not in (ORDER, "estimated_cost_usd")]
    return Evaluation(
        done.select(*[col(c) for c in published]),
        metrics,
        wrong,
        evaluation_summary(done, metrics, model),
    )


