"""The benchmark tables seen as the inputs of label operations.

Every view is a projection of whole tables; none drops rows.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallymark.functions import PromptSpec
from tallymark.sources import checkpoint_folder

LABELS = ["quality", "toxic"]
LI_LABELS = ["returned", "open"]
RUNS = ["run1", "run2", "run3"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder below the session's shared checkpoint folder."""
    return f"{checkpoint_folder(spark)}/{name}-{uuid.uuid4().hex}"


def reconstructions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw export: three reconstructions per scan."""
    return table(spark, sf_dir, "documents").selectExpr(
        "doc_id AS _ord",
        "concat('scan_', doc_id div 3, '_', doc_id % 3 + 1, '.nii.gz') AS VolumeName",
        "text AS Findings",
        "source AS Impressions",
        "lang",
    )


def reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").selectExpr(
        "doc_id AS _ord", "concat('doc_', doc_id) AS VolumeName", "text AS report_text"
    )


def partly_blank_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports whose French texts are missing and whose German ones are blank."""
    return table(spark, sf_dir, "documents").selectExpr(
        "doc_id AS _ord",
        "concat('doc_', doc_id) AS VolumeName",
        "CASE WHEN lang = 'fr' THEN NULL WHEN lang = 'de' THEN concat(chr(160), ' ', chr(9))"
        " ELSE text END AS report_text",
    )


def truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "labels").selectExpr(
        "doc_id AS _ord", "concat('doc_', doc_id, '_1.nii.gz') AS VolumeName", "quality", "toxic"
    )


def run(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    rules = {
        "run1": ("n_chars >= 400", "doc_id % 7 = 0"),
        "run2": ("n_chars >= 600", "doc_id % 5 = 0"),
        "run3": ("n_chars % 3 <> 0", "n_chars % 11 = 0"),
    }
    quality, toxic = rules[name]
    return table(spark, sf_dir, "documents").selectExpr(
        "doc_id AS _ord",
        "concat('doc_', doc_id, '_2.nii') AS VolumeName",
        f"cast({quality} AS int) AS quality",
        f"cast({toxic} AS int) AS toxic",
    )


def runs(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return {name: run(spark, sf_dir, name) for name in RUNS}


def lines(spark: SparkSession, sf_dir: str, returned: str, open_: str) -> DataFrame:
    """Line items as a large label table whose IDs repeat."""
    return table(spark, sf_dir, "lineitem").selectExpr(
        "cast(round(l_extendedprice * 100) AS bigint) * 100000000000 + l_partkey AS _ord",
        "concat('line_', l_orderkey, '_', l_linenumber, '_1.nii.gz') AS VolumeName",
        f"cast({returned} AS int) AS returned",
        f"cast({open_} AS int) AS open",
    )


def line_truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines(spark, sf_dir, "l_returnflag = 'R'", "l_linestatus = 'O'")


def line_runs(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return {
        "run1": lines(spark, sf_dir, "l_discount >= 0.05", "l_tax >= 0.04"),
        "run2": lines(spark, sf_dir, "l_tax >= 0.04", "l_quantity >= 25"),
        "run3": lines(spark, sf_dir, "l_quantity >= 25", "l_discount >= 0.05"),
    }


def line_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as the per-label calls of a report, the order being the report."""
    return table(spark, sf_dir, "lineitem").selectExpr(
        "l_orderkey AS report",
        "struct(l_linenumber, l_partkey, l_extendedprice) AS position",
        "l_partkey AS prompt_tokens",
        "l_suppkey AS completion_tokens",
        "l_partkey + l_suppkey AS total_tokens",
        "l_quantity AS latency_seconds",
        "cast(l_linenumber AS bigint) AS retry_count",
        "CASE WHEN l_returnflag = 'R' THEN 'error' WHEN l_returnflag = 'A' THEN 'skipped'"
        " ELSE 'success' END AS status",
        "CASE WHEN l_returnflag = 'R' THEN concat('failed at ', l_suppkey) ELSE '' END AS error_message",
        "CASE WHEN l_linestatus = 'O' THEN concat('req-', l_partkey) ELSE '' END AS request_id",
        "concat('model-', l_linestatus) AS model_version",
        "CASE WHEN l_returnflag = 'A' THEN '' ELSE date_format(l_shipdate, 'yyyy-MM-dd') END"
        " AS started_at_utc",
        "CASE WHEN l_returnflag = 'A' THEN NULL ELSE date_format(l_shipdate, 'yyyy-MM-dd') END"
        " AS ended_at_utc",
    )


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as model answers: fenced, plain, broken and of various value types."""
    return table(spark, sf_dir, "events").selectExpr(
        "event_id",
        "event_type",
        "CASE event_type"
        " WHEN 'view' THEN concat('Answer:\\n```json\\n', props, '\\n```')"
        " WHEN 'click' THEN props"
        " WHEN 'error' THEN concat(props, ' trailing')"
        " WHEN 'signup' THEN concat('{\"K\": \"', if(value >= 20, ' Yes', 'no'), '\"}')"
        " ELSE concat('[', props, ']') END AS content",
    )


def usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as token usage of models, one of which has no price."""
    return table(spark, sf_dir, "documents").selectExpr(
        "doc_id",
        "CASE lang WHEN 'en' THEN 'gpt-5-nano-2025' WHEN 'fr' THEN 'GPT-5-mini'"
        " WHEN 'de' THEN 'gpt-4.1' ELSE 'unknown' END AS model",
        "n_chars div 4 AS prompt_tokens",
        "12 + doc_id % 5 AS completion_tokens",
    )


def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An earlier run over the labelled documents; poor ones had other IDs then."""
    labels = table(spark, sf_dir, "labels")
    return (
        table(spark, sf_dir, "documents")
        .join(labels, "doc_id")
        .selectExpr(
            "doc_id AS _ord",
            "concat(if(quality = 1, 'doc_', 'old_'), doc_id) AS VolumeName",
            "quality",
            "toxic",
            "cast(n_chars AS bigint) AS prompt_tokens",
            "sha2(text, 256) AS report_hash",
            "if(toxic = 1, 'error', 'success') AS status",
        )
    )


PROMPT = PromptSpec(
    system_prompt="Decide for each finding whether the report shows it.",
    labels=("long text", "mentions the"),
    examples=(
        {"report": "A short note.", "output": {"long text": 0, "mentions the": 0, "other": 1}},
        {"report": "All of the rest.", "output": '{"mentions the": 1, "long text": 0}'},
        {"report": "Unclear.", "output": "no answer"},
    ),
)
SINGLE_PROMPT = PromptSpec(PROMPT.system_prompt, PROMPT.labels, "single", PROMPT.examples)


def keyword_model(flaky: bool = False):
    """Factory of a rule-based stand-in for a model.

    It reads the report out of the user message. With ``flaky``, reports whose
    length divides by 3 fail once before they are answered, and those whose
    length divides by 7 always fail.
    """

    def factory():
        import json

        failed_once = set()

        def call(messages):
            user = messages[-1]["content"]
            start = len('Report:\n"""\n')
            end = user.rindex('\n"""\n\nTarget findings:\n')
            report, listing = user[start:end], user[end:]
            if flaky and len(report) % 7 == 0:
                raise ConnectionError("service down")
            if flaky and len(report) % 3 == 0 and user not in failed_once:
                failed_once.add(user)
                raise TimeoutError("try again")
            failed_once.discard(user)
            found = {}
            if "- long text" in listing:
                found["Long Text"] = len(report) >= 400
            if "- mentions the" in listing:
                found["mentions the"] = "present" if "the " in report else "absent"
            text = json.dumps(found)
            if len(report) % 5 == 0:
                text = f"```json\n{text}\n```"
            if len(report) % 11 == 0:
                text = text.replace("{", "[")
            return {
                "content": text,
                "prompt_tokens": len(report),
                "completion_tokens": 10,
                "request_id": f"req-{len(report)}",
                "model_version": "keyword-1",
                "finish_reason": "stop",
            }

        return call

    return factory
