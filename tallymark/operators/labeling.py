"""Batch labelling: one model call per report, or per report and label.

Prompt text and response handling are native expressions. Only the call itself
runs in Python, once per row, inside ``mapInArrow``; the part of the prompt
that never changes is added there, so it is not shipped with every row.

Calls are paid for and not repeatable: write the result (see
``durable.materialise``) before using it twice.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.coercion import is_blank
from ..functions.costs import Pricing, estimate_cost, total_tokens
from ..functions.prompts import PromptSpec, leading_messages, user_message, user_message_for
from ..functions.responses import label_value, parse_object, response_error, strip_code_fence
from ..functions.text import report_hash
from .columns import ID, ORDER, canonical_id, col, normalize_run_rows, order_column, require_columns

Messages = list[dict[str, str]]
ModelCall = Callable[[Messages], Mapping[str, Any]]
ModelFactory = Callable[[], ModelCall]

SEPARATOR = " | "

CALL_SCHEMA = """
    _ord bigint, VolumeName string, report_hash string, label_pos int, label string,
    messages_count int, outcome string, content string, finish_reason string,
    tool_calls_present boolean, prompt_tokens bigint, completion_tokens bigint,
    reported_total bigint, latency_seconds double, call_error string, request_id string,
    model_version string, retry_count bigint, started_at_utc string, ended_at_utc string,
    user_message string
"""
_CALL_FIELDS = [tuple(field.split()) for field in CALL_SCHEMA.split(",")]
#: Calls whose texts and answers a task holds as Python objects, and at least so many for every thread.
AT_ONCE, AT_ONCE_EACH = 256, 32


def call_model(
    reports: DataFrame,
    prompt: PromptSpec,
    model_factory: ModelFactory,
    *,
    model: str = "",
    id_col: str = ID,
    text_col: str = "report_text",
    order_by: str | None = None,
    max_retries: int = 5,
    retry_on: tuple[type[BaseException], ...] = (OSError,),
    wait_seconds: tuple[float, float] = (1.0, 4.0),
    partitions: int | None = None,
    side_by_side: int = 1,
    keep_request: bool = False,
) -> DataFrame:
    """Run the model over reports; one row per call, plus one per blank report.

    ``model_factory`` is called once per partition and returns a function from
    a message list to a mapping with ``content`` and optionally
    ``prompt_tokens``, ``completion_tokens``, ``total_tokens``, ``request_id``,
    ``model_version``, ``finish_reason`` and ``tool_calls_present``.

    ``retry_on`` errors and empty answers are tried again, up to ``max_retries``
    attempts with a doubling wait. Any other error ends the row's attempts at
    once. Errors are returned in the row; they never fail the task.

    ``partitions`` sets how many tasks make calls (by default two for every core,
    however the table is stored), and ``side_by_side`` how many calls a task has
    under way at once; a call function must then allow several threads. Results
    keep the row order. ``keep_request`` keeps the user message with the call, for
    a log that includes texts.
    """
    named = canonical_id(reports, id_col)
    require_columns(named, [ID, text_col])
    blank = is_blank(col(text_col))
    rows = named.select(
        order_column(named, order_by).cast("bigint").alias(ORDER),
        col(ID).cast("string").alias(ID),
        report_hash(col(text_col)).alias("report_hash"),
        F.when(~blank, col(text_col)).alias("_text"),
    )
    if partitions is None:
        partitions = 2 * reports.sparkSession.sparkContext.defaultParallelism
    # The row order is unique, so a hot ID or a hot text cannot pile up.
    rows = rows.repartition(partitions, ORDER)
    single = prompt.mode == "single"
    if single:
        pieces = F.array(
            *[
                F.struct(F.lit(i).alias("label_pos"), F.lit(name).alias("label"))
                for i, name in enumerate(prompt.labels)
            ]
        )
        rows = rows.select("*", F.inline(F.when(col("_text").isNotNull(), pieces).otherwise(F.slice(pieces, 1, 1))))
        asked = user_message_for(col("_text"), col("label"))
    else:
        rows = rows.select("*", F.lit(0).alias("label_pos"), F.lit("").alias("label"))
        asked = user_message(col("_text"), prompt.labels)
    requests = rows.select(ORDER, ID, "report_hash", "label_pos", "label", asked.alias("_user"))
    leads = leading_by_label(prompt)
    policy = (model, max_retries, retry_on, wait_seconds)
    most = max(AT_ONCE, AT_ONCE_EACH * side_by_side)

    def run(batches):
        from concurrent.futures import ThreadPoolExecutor

        ask = caller(model_factory, leads, *policy)
        with ThreadPoolExecutor(side_by_side) as pool:
            for batch in batches:
                for start in range(0, batch.num_rows, most):
                    part = batch.slice(start, most)
                    yield with_answers(part, list(pool.map(ask, part["label"].to_pylist(), part["_user"].to_pylist())), keep_request)

    return requests.mapInArrow(run, CALL_SCHEMA)


def leading_by_label(prompt: PromptSpec) -> dict[str, Messages]:
    """The fixed part of a call's messages, by the label it asks for ("" for all)."""
    if prompt.mode == "single":
        return {name: leading_messages(prompt, [name]) for name in prompt.labels}
    return {"": leading_messages(prompt, list(prompt.labels))}


def caller(
    model_factory: ModelFactory,
    leads: Mapping[str, Messages],
    model: str,
    max_retries: int,
    retry_on: tuple[type[BaseException], ...],
    wait_seconds: tuple[float, float],
) -> Callable[[str, str | None], dict[str, Any]]:
    """What a task does per call: (label, user message) to the fields of an outcome."""
    import time
    from datetime import datetime, timezone

    call = model_factory()

    def now() -> str:
        stamp = datetime.now(timezone.utc).isoformat(timespec="milliseconds")
        return stamp.replace("+00:00", "Z")

    def attempt_call(messages: Messages) -> tuple[dict[str, Any] | None, str, int]:
        """Answer or error text, with the number of attempts."""
        tries = 0
        while True:
            tries += 1
            try:
                answer = dict(call(messages))
                if str(answer.get("content") or "").strip():
                    return answer, "", tries
                failure, again = "Empty response from LLM", True
            except Exception as error:
                failure, again = str(error), isinstance(error, retry_on)
            if not again or tries >= max_retries:
                return None, failure, tries
            time.sleep(min(max(2.0 ** (tries - 1), wait_seconds[0]), wait_seconds[1]))

    def ask(label: str, user: str | None) -> dict[str, Any]:
        if user is None:
            return {"outcome": "skipped", "messages_count": 0}
        messages = [*leads[label], {"role": "user", "content": user}]
        started, clock = now(), time.perf_counter()
        answer, failure, tries = attempt_call(messages)
        row = {
            "latency_seconds": time.perf_counter() - clock,
            "messages_count": len(messages),
            "retry_count": tries,
            "started_at_utc": started,
            "ended_at_utc": now(),
            "model_version": model,
        }
        if answer is None:
            return row | {"outcome": "failed", "call_error": failure}
        return row | {
            "outcome": "answered",
            "content": str(answer["content"]),
            "prompt_tokens": answer.get("prompt_tokens") or 0,
            "completion_tokens": answer.get("completion_tokens") or 0,
            "reported_total": answer.get("total_tokens") or 0,
            "request_id": answer.get("request_id") or "",
            "model_version": answer.get("model_version") or model,
            "finish_reason": answer.get("finish_reason") or "",
            "tool_calls_present": bool(answer.get("tool_calls_present")),
        }

    return ask


def with_answers(batch: Any, results: Sequence[Mapping[str, Any]], keep_request: bool = False) -> Any:
    """An Arrow batch of requests with the fields of their outcomes; ``_user`` becomes ``user_message``, if kept."""
    import pyarrow as pa

    kinds = {
        "bigint": (pa.int64(), lambda r, name: int(r.get(name, 0))),
        "int": (pa.int32(), lambda r, name: int(r.get(name, 0))),
        "double": (pa.float64(), lambda r, name: float(r.get(name, 0.0))),
        "boolean": (pa.bool_(), lambda r, name: bool(r.get(name, False))),
        "string": (pa.string(), lambda r, name: str(r.get(name, ""))),
    }
    columns = []
    for name, kind in _CALL_FIELDS:
        type_, read = kinds[kind]
        if name in batch.schema.names:
            columns.append(batch.column(name))
        elif name == "user_message":
            columns.append(batch.column("_user") if keep_request else pa.nulls(batch.num_rows, type_))
        else:
            columns.append(pa.array([read(r, name) for r in results], type_))
    return pa.RecordBatch.from_arrays(columns, [name for name, _ in _CALL_FIELDS])


def read_answers(calls: DataFrame) -> DataFrame:
    """Add ``status``, ``error_message``, ``total_tokens`` and ``parsed`` to calls."""
    body = calls.withColumn("_body", strip_code_fence(col("content")))
    parsed = body.withColumn("parsed", parse_object(col("_body")))
    answered = col("outcome") == "answered"
    message = F.when(answered, response_error(col("_body"), col("parsed"))).otherwise(
        F.coalesce(col("call_error"), F.lit(""))
    )
    told = parsed.withColumn("error_message", message)
    status = (
        F.when(col("outcome") == "skipped", F.lit("skipped"))
        .when(answered & (col("error_message") == ""), F.lit("success"))
        .otherwise(F.lit("error"))
    )
    total = total_tokens(col("reported_total"), col("prompt_tokens"), col("completion_tokens"))
    return told.withColumns({"status": status, "total_tokens": total}).drop("_body")


def combine_meta(calls: DataFrame, keys: Sequence[str], position: Column, values: Sequence[Column] = ()) -> DataFrame:
    """Collapse the calls of a report into one metadata row.

    Sums tokens, latency and attempts; any error makes the row an error, only
    skipped calls make it skipped. Request IDs, distinct errors and distinct
    models are joined in call order. A report has one call per label, so the
    lists are as long as the label list. ``values`` are further aggregates.
    """

    named = ("error_message", "request_id", "model_version")
    call = F.struct(position.alias("p"), *[F.nullif(col(n), F.lit("")).alias(n) for n in named])

    def joined(name: str, distinct: bool) -> Column:
        texts = col("_calls")[name]
        # array_join leaves nulls out.
        return F.array_join(F.array_distinct(texts) if distinct else texts, SEPARATOR).alias(name)

    def total(name: str, kind: str) -> Column:
        return F.sum(F.coalesce(col(name), F.lit(0))).cast(kind).alias(name)

    known = F.coalesce(col("status"), F.lit("")) != ""
    any_error = F.coalesce(F.bool_or(col("status") == "error"), F.lit(False))
    all_skipped = F.coalesce(F.bool_and(F.when(known, col("status") == "skipped")), F.lit(False))
    grouped = calls.groupBy(*keys).agg(
        total("prompt_tokens", "bigint"),
        total("completion_tokens", "bigint"),
        total("total_tokens", "bigint"),
        total("latency_seconds", "double"),
        total("retry_count", "bigint"),
        F.when(any_error, F.lit("error"))
        .when(all_skipped, F.lit("skipped"))
        .otherwise(F.lit("success"))
        .alias("status"),
        F.coalesce(F.min(F.nullif(col("started_at_utc"), F.lit(""))), F.lit("")).alias("started_at_utc"),
        F.coalesce(F.max(F.nullif(col("ended_at_utc"), F.lit(""))), F.lit("")).alias("ended_at_utc"),
        F.sort_array(F.collect_list(call)).alias("_calls"),
        *values,
    )
    others = [col(name) for name in grouped.columns if name != "_calls"]
    return grouped.select(
        *others,
        joined("error_message", True),
        joined("request_id", False),
        joined("model_version", True),
    )


def collect_labels(
    calls: DataFrame,
    prompt: PromptSpec,
    *,
    model: str = "",
    pricing: Pricing | None = None,
    cost_precision: int = 8,
    keep_order: bool = False,
) -> DataFrame:
    """Turn calls into label-run rows, one per report.

    Failed, malformed and skipped reports get 0 for every label. Cost is priced
    by the configured model.
    """
    answers = read_answers(calls)
    labels = prompt.labels
    if prompt.mode == "single":
        own = label_value(col("parsed"), col("label"))
        valued = answers.withColumn("_own", F.when(col("status") == "success", own).otherwise(F.lit(0)))
        per_label = [
            F.coalesce(F.max(F.when(col("label_pos") == i, col("_own"))), F.lit(0)).alias(name)
            for i, name in enumerate(labels)
        ]
        rows = combine_meta(valued, [ORDER, ID, "report_hash"], col("label_pos"), per_label)
    else:
        good = col("status") == "success"
        rows = answers.select(
            "*",
            *[
                F.when(good, label_value(col("parsed"), F.lit(name))).otherwise(F.lit(0)).alias(name)
                for name in labels
            ],
        )
    cost = estimate_cost(F.lit(model), col("prompt_tokens"), col("completion_tokens"), pricing, cost_precision)
    priced = rows.withColumn("estimated_cost_usd", cost)
    return normalize_run_rows(priced, labels, cost_precision, [ORDER] if keep_order else [])


def label_reports(
    reports: DataFrame,
    prompt: PromptSpec,
    model_factory: ModelFactory,
    *,
    model: str = "",
    pricing: Pricing | None = None,
    cost_precision: int = 8,
    keep_order: bool = False,
    **options: Any,
) -> DataFrame:
    """Label reports: ``call_model`` (which takes ``options``) and ``collect_labels``."""
    calls = call_model(reports, prompt, model_factory, model=model, **options)
    return collect_labels(
        calls,
        prompt,
        model=model,
        pricing=pricing,
        cost_precision=cost_precision,
        keep_order=keep_order,
    )


def call_log(
    calls: DataFrame, prompt: PromptSpec, model: str = "", include_text: bool = False
) -> DataFrame:
    """Request and response events of every call made, for a JSON-lines log.

    Fields an event does not have are null and so absent from the JSON. The
    answer text is only included on request; request text is not kept.
    """
    made = read_answers(calls).where(col("outcome") != "skipped")
    asked = F.when(col("label") == "", F.array(*[F.lit(x) for x in prompt.labels])).otherwise(
        F.array(col("label"))
    )
    good = col("status") == "success"
    content = F.when(good, F.coalesce(col("content"), F.lit(""))).otherwise(F.lit(""))

    def event(kind: str, given: dict[str, Column]) -> Column:
        fields = {
            "event": ("string", F.lit(kind)),
            "timestamp_utc": ("string", None),
            "model": ("string", None),
            "labels": ("array<string>", None),
            "report_hash": ("string", None),
            "messages_count": ("int", None),
            "messages": ("array<struct<role:string,content:string>>", None),
            "request_id": ("string", None),
            "model_version": ("string", None),
            "content_length": ("int", None),
            "finish_reason": ("string", None),
            "tool_calls_present": ("boolean", None),
            "status": ("string", None),
            "error_message": ("string", None),
            "prompt_tokens": ("bigint", None),
            "completion_tokens": ("bigint", None),
            "total_tokens": ("bigint", None),
            "content": ("string", None),
        }
        return F.struct(
            *[
                given.get(name, F.lit(None) if default is None else default).cast(kind).alias(name)
                for name, (kind, default) in fields.items()
            ]
        )

    sent = {
        "timestamp_utc": col("started_at_utc"),
        "model": F.lit(model),
        "labels": asked,
        "report_hash": col("report_hash"),
        "messages_count": col("messages_count"),
    }
    if include_text:
        sent["messages"] = F.when(col("user_message").isNotNull(), _sent_messages(prompt))
    request = event("request", sent)
    answer = {name: col(name) for name in (
        "request_id", "model_version", "finish_reason", "tool_calls_present", "status",
        "error_message", "prompt_tokens", "completion_tokens", "total_tokens",
    )}
    answer |= {"timestamp_utc": col("ended_at_utc"), "content_length": F.length(content)}
    if include_text:
        answer["content"] = content
    response = event("response", answer)
    keys = [col(ORDER), col(ID), col("label_pos")]
    return made.select(*keys, F.inline(F.array(request, response)))


def _sent_messages(prompt: PromptSpec) -> Column:
    """Message list of a call, rebuilt around its user message."""

    def listed(names: Sequence[str]) -> Column:
        fixed = [F.struct(F.lit(m["role"]).alias("role"), F.lit(m["content"]).alias("content")) for m in leading_messages(prompt, names)]
        return F.array(*fixed, F.struct(F.lit("user").alias("role"), col("user_message").alias("content")))

    if prompt.mode == "multi":
        return listed(prompt.labels)
    chain = F.when(col("label") == prompt.labels[0], listed([prompt.labels[0]]))
    for name in prompt.labels[1:]:
        chain = chain.when(col("label") == name, listed([name]))
    return chain
