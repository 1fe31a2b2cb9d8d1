"""DataFrame-in, DataFrame-out operators."""

from .agreement import (
    agreement_summary,
    all_sets_agreement,
    pairwise_agreement,
    pairwise_summary,
    run_votes,
)
from .align import align_pair, align_runs, normalize_ids, pair_labels, pair_table, unmatched_ids
from .asof import asof_join
from .bits import all_sets_agreement_bits, bit_votes, pairwise_agreement_bits
from .columns import (
    META_COLUMNS,
    canonical_id,
    normalize_run_rows,
    prefix_columns,
    require_columns,
    resolve_column,
    run_columns,
    shared_labels,
)
from .consensus import STRATEGIES, consensus, consensus_summary, vote_threshold
from .dedupe import dedupe_first, keep_last, unique_scans
from .examples import example_block, format_examples, take_positions
from .labeling import (
    call_log,
    call_model,
    collect_labels,
    combine_meta,
    label_reports,
    read_answers,
)
from .metrics import (
    binary_metrics,
    compare_by,
    compare_many,
    compare_metrics,
    compare_summary,
    confusion_counts,
    discrepancies,
    evaluation_summary,
    pair_patterns,
    run_totals,
    with_averages,
)
from .pricing import price_usage
from .resume import Resume, resume_match
from .sampling import (
    allocate_samples,
    combo_counts,
    label_prevalence,
    sample_rows,
    stratified_allocation,
    stratified_sample,
    top_up,
)
from .sketches import id_sketches, merge_ids, overlap, quantiles, value_sketches
from .summaries import (
    classify_error,
    discrepancy_summary,
    discrepancy_totals,
    metrics_mean_std,
    top_rows,
)

__all__ = [name for name in dir() if not name.startswith("_") and name[0].islower() or name in ("META_COLUMNS", "Resume", "STRATEGIES")]
