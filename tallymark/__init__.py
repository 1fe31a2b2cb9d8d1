"""Label operations on report tables, as Spark DataFrame operators."""

from . import functions, operators, plans, sources, streaming
from .functions import DEFAULT_PRICING, IdRule, PromptSpec
from .session import session

__all__ = [
    "DEFAULT_PRICING",
    "IdRule",
    "PromptSpec",
    "functions",
    "operators",
    "plans",
    "session",
    "sources",
    "streaming",
]
