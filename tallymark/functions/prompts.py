"""Prompt construction."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

MODES = ("multi", "single")

# The wording around a report in the user message.
_BEFORE_REPORT = 'Report:\n"""\n'
_AFTER_REPORT = '\n"""\n\nTarget findings:\n'
_INSTRUCTION = "\nReturn a JSON object that only contains these findings as keys with 0/1 values."


@dataclass(frozen=True)
class PromptSpec:
    """A prompt configuration.

    ``examples`` are mappings with ``report`` and ``output``; the output is a
    mapping of label to 0/1 or a JSON text of one.
    """

    system_prompt: str
    labels: tuple[str, ...]
    mode: str = "multi"
    examples: tuple[Mapping[str, Any], ...] = field(default=())
    examples_enabled: bool = True

    def __post_init__(self) -> None:
        object.__setattr__(self, "labels", tuple(self.labels))
        object.__setattr__(self, "examples", tuple(self.examples or ()))
        object.__setattr__(self, "mode", str(self.mode).lower())
        if self.mode not in MODES:
            raise ValueError(f"mode must be one of {MODES}, not {self.mode!r}")
        if not self.labels:
            raise ValueError("a prompt needs at least one label")

    @property
    def active_examples(self) -> tuple[Mapping[str, Any], ...]:
        return self.examples if self.examples_enabled else ()


def active_labels(override: str | Sequence[str] | None, default: Sequence[str]) -> list[str]:
    """Trimmed, non-blank override names, or the default list when none is left."""
    names = [override] if isinstance(override, str) else list(override or ())
    trimmed = [str(name).strip() for name in names]
    return [name for name in trimmed if name] or list(default)


def example_output(output: Any, labels: Sequence[str]) -> str:
    """Answer text of a few-shot example, cut down to the labels asked for."""
    if isinstance(output, str):
        try:
            output = json.loads(output)
        except json.JSONDecodeError:
            return output
    if not isinstance(output, Mapping):
        return str(output)
    return json.dumps({name: value for name, value in output.items() if name in labels})


def user_message(report: Column, labels: Sequence[str]) -> Column:
    """User message for a report column."""
    listing = "\n".join(f"- {name}" for name in labels)
    return F.concat(F.lit(_BEFORE_REPORT), report, F.lit(_AFTER_REPORT + listing + _INSTRUCTION))


def user_message_for(report: Column, label: Column) -> Column:
    """User message asking for the single label held in a column."""
    return F.concat(
        F.lit(_BEFORE_REPORT), report, F.lit(_AFTER_REPORT + "- "), label, F.lit(_INSTRUCTION)
    )


def leading_messages(prompt: PromptSpec, labels: Sequence[str]) -> list[dict[str, str]]:
    """The part of the message list that is the same for every report."""
    listing = "\n".join(f"- {name}" for name in labels)
    messages = [{"role": "system", "content": prompt.system_prompt}]
    for example in prompt.active_examples:
        report = example.get("report", "")
        asked = f"{_BEFORE_REPORT}{report}{_AFTER_REPORT}{listing}{_INSTRUCTION}"
        answer = example_output(example.get("output", {}), labels)
        messages.append({"role": "user", "content": asked})
        messages.append({"role": "assistant", "content": answer})
    return messages


def build_messages(
    report: Column, prompt: PromptSpec, labels: str | Sequence[str] | None = None
) -> Column:
    """Whole message list of a report as ARRAY<STRUCT<role, content>>."""
    names = active_labels(labels, prompt.labels)
    fixed = [
        F.struct(F.lit(m["role"]).alias("role"), F.lit(m["content"]).alias("content"))
        for m in leading_messages(prompt, names)
    ]
    asked = F.struct(F.lit("user").alias("role"), user_message(report, names).alias("content"))
    return F.array(*fixed, asked)
