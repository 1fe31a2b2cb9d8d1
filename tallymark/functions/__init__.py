"""Column-level expressions."""

from .coercion import is_blank, parse_number, round4, safe_number, strip_space, to_binary_int
from .costs import DEFAULT_PRICING, estimate_cost, match_pricing, total_tokens
from .identifiers import DEFAULT_SUFFIXES, IdRule, scan_id, strip_reconstruction, strip_suffixes
from .prompts import PromptSpec, active_labels, build_messages, example_output, user_message
from .responses import label_value, normalize_binary, parse_object, response_error, strip_code_fence
from .text import build_report_text, report_hash, report_length

__all__ = [
    "DEFAULT_PRICING",
    "DEFAULT_SUFFIXES",
    "IdRule",
    "PromptSpec",
    "active_labels",
    "build_messages",
    "build_report_text",
    "estimate_cost",
    "example_output",
    "is_blank",
    "label_value",
    "match_pricing",
    "normalize_binary",
    "parse_number",
    "parse_object",
    "report_hash",
    "report_length",
    "response_error",
    "round4",
    "safe_number",
    "scan_id",
    "strip_code_fence",
    "strip_reconstruction",
    "strip_space",
    "strip_suffixes",
    "to_binary_int",
    "total_tokens",
    "user_message",
]
