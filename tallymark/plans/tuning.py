"""Small stratified tuning sets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from ..operators.columns import ID
from ..operators.sampling import label_prevalence, stratified_sample
from ..durable import materialise
from .results import TuningSet


def make_tuning_set(
    df: DataFrame, labels: Sequence[str], n: int = 100, seed: int = 42, key: str = ID
) -> TuningSet:
    """A stratified sample with the label prevalence of input and sample."""
    sample = materialise(stratified_sample(df, labels, n, key, seed))
    prevalence = label_prevalence({"input": df, "output": sample}, labels)
    return TuningSet(sample, prevalence)
