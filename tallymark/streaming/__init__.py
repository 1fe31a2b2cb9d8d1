"""Structured Streaming forms."""

from .incremental import incremental_label
from .stateful import incremental_label_state

__all__ = ["incremental_label", "incremental_label_state"]
