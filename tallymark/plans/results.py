"""Result bundles that can be saved as a folder of tables."""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import DataFrame

from ..sources.sinks import write_summary, write_table


class Bundle:
    """Base of result dataclasses whose fields are DataFrames (or dicts of them)."""

    def save(self, folder: str, format: str = "parquet") -> list[str]:
        """Write every table below ``folder``; one-row summaries become JSON."""
        written = []
        for field in fields(self):
            value = getattr(self, field.name)
            tables = value if isinstance(value, dict) else {field.name: value}
            for name, table in tables.items():
                if not isinstance(table, DataFrame):
                    continue
                target = f"{folder}/{name}"
                if name == "run_summary":
                    write_summary(table, target)
                else:
                    write_table(table, target, format)
                written.append(target)
        return written


@dataclass(frozen=True)
class LabelRun(Bundle):
    labels: DataFrame
    run_summary: DataFrame
    resume_stats: DataFrame | None


@dataclass(frozen=True)
class Evaluation(Bundle):
    evaluation_predictions: DataFrame
    evaluation_metrics: DataFrame
    discrepancies: DataFrame
    run_summary: DataFrame


@dataclass(frozen=True)
class Comparison(Bundle):
    evaluation_metrics: DataFrame
    discrepancies: DataFrame
    run_summary: DataFrame


@dataclass(frozen=True)
class Agreement(Bundle):
    pairwise_agreement: DataFrame
    pairwise_agreement_summary: DataFrame
    all_sets_agreement: DataFrame
    run_summary: DataFrame


@dataclass(frozen=True)
class Ensemble(Bundle):
    consensus: dict[str, DataFrame]
    run_summary: DataFrame


@dataclass(frozen=True)
class TuningSet(Bundle):
    tuning_set: DataFrame
    label_prevalence: DataFrame
