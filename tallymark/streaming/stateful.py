"""Labelling reports as they arrive, remembering IDs and texts in keyed state."""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence
from typing import Any

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..functions.coercion import is_blank
from ..functions.costs import Pricing
from ..functions.prompts import PromptSpec, user_message, user_message_for
from ..functions.text import report_hash
from ..operators.columns import ID, ORDER, canonical_id, col, require_columns, run_columns
from ..operators.labeling import ModelFactory, caller, collect_labels, leading_by_label

BATCH = "batch_id"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_REPORTS = f"place bigint, {ID} string, report_hash string, users array<string>"
_REPORT = Row("place", ID, "report_hash", "users")
# A report leaves Python as one row; its calls are told apart by Spark.
_ANSWERED = f"place bigint, {ID} string, report_hash string, reuse string, outcomes string"
_ANSWER = Row("place", ID, "report_hash", "reuse", "outcomes")
_NUMBERS = ("prompt_tokens", "completion_tokens", "reported_total", "retry_count", "messages_count")
_TEXTS = (
    "outcome", "content", "finish_reason", "call_error", "request_id",
    "model_version", "started_at_utc", "ended_at_utc",
)
_OUTCOMES = (
    f"array<struct<{', '.join(f'{n}: bigint' for n in _NUMBERS)}, {', '.join(f'{n}: string' for n in _TEXTS)},"
    " latency_seconds: double, tool_calls_present: boolean>>"
)


class _FirstOfId(StatefulProcessor):
    """Lets the first report of every ID pass; an ID that came in an earlier batch passes no more."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("seen", "was boolean")

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        if key[1]:  # without an ID it is no one's repetition
            for row in rows:
                yield _REPORT(row.place, row[ID], row.report_hash, row.users)
            return
        known, first = self.seen.exists(), None
        for row in rows:  # to their end, also if none is wanted
            if not known and (first is None or row.place < first.place):
                first = row
        if first is not None:
            self.seen.update((True,))
            yield _REPORT(first.place, first[ID], first.report_hash, first.users)

    def close(self) -> None:
        pass


class _AnswerOfText(StatefulProcessor):
    """Calls the model for the first report of a text and gives its answers to all others."""

    def __init__(self, prompt: PromptSpec, model_factory: ModelFactory, policy: tuple) -> None:
        self.names = list(prompt.labels) if prompt.mode == "single" else [""]
        self.setting = (model_factory, leading_by_label(prompt), *policy)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.answers = handle.getValueState("answers", "outcomes string")
        self.ask = None

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        if key[1]:  # a blank report: one skipped row, no call
            skipped = _packed([{"outcome": "skipped", "messages_count": 0}])
            for row in rows:
                yield _ANSWER(row.place, row[ID], row.report_hash, "none", skipped)
            return
        known = self.answers.get()
        held = known[0] if known else None
        users, reports = None, []
        for row in rows:  # equal texts: one is kept
            users = row.users if users is None else users
            reports.append((row.place, row[ID], row.report_hash))
        reports.sort(key=lambda report: report[0])
        for report in reports:
            if held is not None:
                yield _ANSWER(*report, "hash", held)
                continue
            outcomes = [self._ask(name, user) for name, user in zip(self.names, users)]
            packed = _packed(outcomes)
            if all(o["outcome"] == "answered" for o in outcomes):
                held = packed
                self.answers.update((held,))
            yield _ANSWER(*report, "none", packed)

    def _ask(self, label: str, user: str) -> dict[str, Any]:
        if self.ask is None:
            self.ask = caller(*self.setting)
        return self.ask(label, user)

    def close(self) -> None:
        pass


def _packed(outcomes: Sequence[dict[str, Any]]) -> str:
    """Outcomes of a report's calls as JSON with every field."""
    return json.dumps(
        [
            {n: int(o.get(n, 0)) for n in _NUMBERS}
            | {n: o.get(n, "") for n in _TEXTS}
            | {"latency_seconds": float(o.get("latency_seconds", 0.0)), "tool_calls_present": bool(o.get("tool_calls_present"))}
            for o in outcomes
        ]
    )


def _calls(answered: DataFrame, prompt: PromptSpec) -> DataFrame:
    """A row per report and call."""
    names = prompt.labels if prompt.mode == "single" else [""]
    listed = answered.select("*", F.posexplode(F.from_json("outcomes", _OUTCOMES)).alias("label_pos", "_outcome"))
    return listed.select(
        col("place").alias(ORDER),
        ID,
        "report_hash",
        "label_pos",
        F.get(F.array(*[F.lit(name) for name in names]), "label_pos").alias("label"),
        "_outcome.*",
        F.lit(None).cast("string").alias("user_message"),
        "reuse",
    )


def incremental_label_state(
    reports: DataFrame,
    output: str,
    checkpoint: str,
    prompt: PromptSpec,
    model_factory: ModelFactory,
    *,
    order_by: str,
    model: str = "",
    pricing: Pricing | None = None,
    cost_precision: int = 8,
    id_col: str = ID,
    text_col: str = "report_text",
    trigger: dict[str, Any] | None = None,
    max_retries: int = 5,
    retry_on: tuple[type[BaseException], ...] = (OSError,),
    wait_seconds: tuple[float, float] = (1.0, 4.0),
) -> StreamingQuery:
    """Start a stream that labels each new report once, at a cost that does not grow with the output.

    What is known lies in the stream's keyed state, not in ``output``: a mark for
    every ID and the model's answers for every text, both stored and versioned
    with the checkpoint. Of an ID the first report by ``order_by`` (unique numbers)
    counts, in the first batch that has it, and later ones are dropped. A text is asked for
    once: other reports with it get the same answers without a call (``reuse`` is
    ``hash``). Calls that failed are not remembered, so the next report with the
    text is asked for again. Reports without an ID repeat no one; blank ones are
    skipped without a call.

    A batch is one partition of the output (``batch_id=<n>``). A batch replayed after a
    crash starts from the state before it and replaces its partition, so rows
    never double; it repeats its own calls only. Calls of one task follow each other; tasks
    are as many as the state's partitions (``spark.sql.shuffle.partitions`` at the
    first start). Reports of one text meet in one task without their texts.
    """
    named = canonical_id(reports, id_col)
    require_columns(named, [ID, text_col, order_by])
    text, key = col(text_col), F.nullif(col(ID).cast("string"), F.lit(""))
    labels = prompt.labels
    asked = [user_message_for(text, F.lit(name)) for name in labels] if prompt.mode == "single" else [user_message(text, labels)]
    order = col(order_by).cast("bigint")
    rows = named.select(
        order.alias("place"),
        col(ID).cast("string").alias(ID),
        # Keys are never null: a group with a null key comes in pieces.
        F.coalesce(key, F.lit("")).alias("known_id"),
        F.when(key.isNull(), order.cast("string")).otherwise("").alias("alone"),
        report_hash(text).alias("report_hash"),
        F.when(~is_blank(text), F.array(*asked)).alias("users"),
    )
    kept = rows.groupBy("known_id", "alone").transformWithState(_FirstOfId(), _REPORTS, "append", "none")
    kept = kept.select("*", F.when(col("users").isNull(), col("place").cast("string")).otherwise("").alias("alone"))
    policy = (model, max_retries, retry_on, wait_seconds)
    answered = kept.groupBy("report_hash", "alone").transformWithState(
        _AnswerOfText(prompt, model_factory, policy), _ANSWERED, "append", "none"
    )
    calls = _calls(answered, prompt)

    def write(batch: DataFrame, batch_id: int) -> None:
        # The whole batch is always computed: that is what moves the state on.
        by_report = F.struct(col(ORDER), col("reuse")).alias(ORDER)
        labelled = collect_labels(batch.withColumn(ORDER, by_report), prompt, model=model, pricing=pricing, cost_precision=cost_precision, keep_order=True)
        columns = [col(c) for c in run_columns(labels)]
        done = labelled.select(*columns, col(ORDER)["reuse"].alias("reuse"))
        done.write.mode("overwrite").parquet(f"{output}/{BATCH}={batch_id}")

    session = reports.sparkSession
    before = session.conf.get(_PROVIDER, None)
    session.conf.set(_PROVIDER, _ROCKSDB)  # the only store that has this kind of state
    try:
        writer = calls.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
        return writer.trigger(**(trigger or {"availableNow": True})).start()
    finally:
        if before is None:
            session.conf.unset(_PROVIDER)
        else:
            session.conf.set(_PROVIDER, before)
