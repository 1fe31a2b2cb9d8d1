"""Sources and sinks."""

from ..durable import checkpoint_folder, materialise
from .layout import align_stored, open_run, store_run
from .sinks import append_labels, write_labels, write_summary, write_table
from .tables import NA_TOKENS, list_files, read_metrics, read_reports, read_table

__all__ = [
    "NA_TOKENS",
    "align_stored",
    "append_labels",
    "checkpoint_folder",
    "list_files",
    "materialise",
    "open_run",
    "read_metrics",
    "read_reports",
    "read_table",
    "store_run",
    "write_labels",
    "write_summary",
    "write_table",
]
