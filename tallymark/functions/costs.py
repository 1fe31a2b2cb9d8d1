"""Token accounting and cost estimates."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from .coercion import round_half_even

Pricing = Mapping[str, Mapping[str, float | None]]

# USD per million tokens, by model key.
DEFAULT_PRICING: Pricing = {
    "gpt-5-pro": {"input_per_million": 15.0, "output_per_million": 120.0},
    "gpt-5": {"input_per_million": 1.25, "output_per_million": 10.0},
    "gpt-5-mini": {"input_per_million": 0.25, "output_per_million": 2.0},
    "gpt-5-nano": {"input_per_million": 0.05, "output_per_million": 0.4},
    "gpt-4.1": {"input_per_million": 3.0, "output_per_million": 12.0},
    "gpt-4.1-mini": {"input_per_million": 0.8, "output_per_million": 3.2},
    "gpt-4.1-nano": {"input_per_million": 0.2, "output_per_million": 0.8},
}


def match_pricing(model: Column, pricing: Pricing | None) -> Column:
    """Rates of the longest pricing key contained in the model name, else null.

    The pricing table is configuration, so it becomes a CASE over literals: the
    substring match runs inside the projection and needs no theta join.
    """
    name = F.lower(model)
    chain = None
    for key in sorted(pricing or {}, key=len, reverse=True):
        rates = pricing[key]
        struct = F.struct(
            _rate(rates.get("input_per_million")).alias("input_per_million"),
            _rate(rates.get("output_per_million")).alias("output_per_million"),
        )
        hit = F.contains(name, F.lit(key.lower()))
        chain = F.when(hit, struct) if chain is None else chain.when(hit, struct)
    if chain is None:
        return F.lit(None).cast("struct<input_per_million:double,output_per_million:double>")
    return chain


def _rate(value: float | None) -> Column:
    return F.lit(None if value is None else float(value)).cast("double")


def estimate_cost(
    model: Column,
    prompt_tokens: Column,
    completion_tokens: Column,
    pricing: Pricing | None,
    precision: int = 8,
) -> Column:
    """Estimated USD; 0 without a matching key or when its rates are incomplete."""
    rates = match_pricing(model, pricing)
    million = F.lit(1_000_000.0)
    cost = (
        prompt_tokens.cast("double") / million * rates["input_per_million"]
        + completion_tokens.cast("double") / million * rates["output_per_million"]
    )
    return F.coalesce(round_half_even(cost, precision), F.lit(0.0))


def total_tokens(total: Column, prompt: Column, completion: Column) -> Column:
    """The reported total, or prompt + completion when it is missing or 0."""
    return F.when(F.coalesce(total, F.lit(0)) == 0, prompt + completion).otherwise(total)
