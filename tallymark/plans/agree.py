"""Agreement and consensus over two or more label runs."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame

from ..functions.identifiers import IdRule
from ..operators.agreement import (
    agreement_summary,
    all_sets_agreement,
    pairwise_agreement,
    pairwise_summary,
    run_votes,
)
from ..operators.align import align_runs
from ..operators.columns import DEFAULT_EXCLUDE, ID, shared_labels
from ..operators.consensus import STRATEGIES, consensus, consensus_summary, vote_threshold
from ..durable import materialise
from .results import Agreement, Ensemble


def agree_runs(
    runs: Mapping[str, DataFrame],
    labels: Sequence[str] | None = None,
    *,
    id_col: str = ID,
    rule: IdRule = IdRule(),
    exclude: Sequence[str] = DEFAULT_EXCLUDE,
    order_by: str | None = None,
) -> Agreement:
    """All agreement tables; the runs are aligned and read once."""
    names = shared_labels(list(runs.values()), labels, exclude)
    aligned = align_runs(runs, names, id_col=id_col, rule=rule, order_by=order_by)
    order = list(runs)
    votes = materialise(run_votes(aligned, order, names))
    pairwise = pairwise_agreement(votes, order)
    return Agreement(
        pairwise,
        pairwise_summary(pairwise),
        all_sets_agreement(votes, order),
        agreement_summary(votes, order, names),
    )


def ensemble_runs(
    runs: Mapping[str, DataFrame],
    labels: Sequence[str] | None = None,
    *,
    strategies: Sequence[str] = STRATEGIES,
    id_col: str = ID,
    rule: IdRule = IdRule(),
    exclude: Sequence[str] = DEFAULT_EXCLUDE,
    order_by: str | None = None,
    output: str | None = None,
) -> Ensemble:
    """One consensus table per strategy, and their summary.

    The aligned runs feed every strategy, so they are computed once, into
    ``<output>/aligned_runs`` or a checkpoint.
    """
    for strategy in strategies:
        vote_threshold(strategy, len(runs))
    names = shared_labels(list(runs.values()), labels, exclude)
    order = list(runs)
    aligned = materialise(
        align_runs(runs, names, id_col=id_col, rule=rule, order_by=order_by),
        None if output is None else f"{output}/aligned_runs",
    )
    tables = {
        f"consensus_{name}": consensus(aligned, order, names, name) for name in strategies
    }
    summary = consensus_summary(run_votes(aligned, order, names), order, strategies)
    return Ensemble(tables, summary)
