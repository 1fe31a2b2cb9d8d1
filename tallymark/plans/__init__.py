"""Complete workflows built from the operators."""

from .agree import agree_runs, ensemble_runs
from .compare import compare_runs
from .evaluate import evaluate_prompt
from .label import generate_labels, resume_batch
from .results import Agreement, Comparison, Ensemble, Evaluation, LabelRun, TuningSet
from .tuning import make_tuning_set

__all__ = [
    "Agreement",
    "Comparison",
    "Ensemble",
    "Evaluation",
    "LabelRun",
    "TuningSet",
    "agree_runs",
    "compare_runs",
    "ensemble_runs",
    "evaluate_prompt",
    "generate_labels",
    "make_tuning_set",
    "resume_batch",
]
