"""One query per operator, over the benchmark tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallymark import operators as ops
from tallymark import plans, sources, streaming
from tallymark.functions import (
    DEFAULT_PRICING,
    IdRule,
    build_messages,
    estimate_cost,
    is_blank,
    label_value,
    parse_object,
    report_hash,
    response_error,
    safe_number,
    scan_id,
    strip_code_fence,
    to_binary_int,
    total_tokens,
)
from tallymark.operators.columns import ORDER

from . import tables as t

LABELS, RUNS = t.LABELS, t.RUNS
CELLS = ["tp", "fp", "fn", "tn"]


# Scans and columns ---------------------------------------------------------


def scan_reports(spark, sf_dir):
    """Write the export as CSV, read it back: line breaks and quotes survive."""
    path = t.scratch(spark, "export")
    raw = t.reconstructions(spark, sf_dir).select("VolumeName", "Findings", "Impressions")
    sources.write_table(raw, path, "csv")
    return sources.read_reports(spark, path).select("VolumeName", "Findings", "Impressions")


def normalize_ids(spark, sf_dir):
    raw = t.reconstructions(spark, sf_dir).select(F.col("VolumeName").alias("raw"), "_ord")
    ids = ops.normalize_ids(raw.select("raw", "_ord", F.col("raw").alias("volumename")))
    kept = IdRule(keep_reconstruction_suffix=True).apply(F.col("raw"))
    return ids.select("raw", "VolumeName", kept.alias("kept"), scan_id(F.col("raw")).alias("scan"))


def dedupe_first(spark, sf_dir):
    raw = t.reconstructions(spark, sf_dir).select("VolumeName", "lang", "Impressions", "_ord")
    return ops.dedupe_first(ops.normalize_ids(raw))


def _noisy_numbers(spark, sf_dir):
    return t.table(spark, sf_dir, "events").selectExpr(
        "event_id",
        "get_json_object(props, '$.k') AS stored",
        "CASE event_id % 7 WHEN 0 THEN concat(event_type, event_id)"
        " WHEN 1 THEN concat(' ', event_id, ' ') WHEN 2 THEN concat(event_id, '.9')"
        " WHEN 3 THEN 'True' WHEN 4 THEN concat(event_id, 'd') WHEN 5 THEN concat('-', event_id, 'e0')"
        " ELSE NULL END AS noisy",
        "value",
    )


def coerce_binary(spark, sf_dir):
    """The stored cell of every event, and beside it a cell of another form."""
    stored, noisy = F.col("stored"), F.col("noisy")
    return _noisy_numbers(spark, sf_dir).select(
        "event_id",
        to_binary_int(stored, T.StringType()).alias("stored_int"),
        safe_number(stored, T.StringType(), -1.0).alias("stored_number"),
        to_binary_int(noisy, T.StringType()).alias("noisy_int"),
        safe_number(noisy, T.StringType(), -1.0).alias("noisy_number"),
        to_binary_int(F.col("value"), T.DoubleType()).alias("value_int"),
    )


def normalize_run_rows(spark, sf_dir):
    calls = t.table(spark, sf_dir, "events").selectExpr(
        "concat('event_', event_id) AS VolumeName",
        "get_json_object(props, '$.k') AS positive",
        "if(event_type = 'view', NULL, cast(event_id AS string)) AS prompt_tokens",
        "'7' AS completion_tokens",
        "cast(if(event_type = 'click', event_id, 0) AS string) AS reported",
        "if(event_type = 'purchase', NULL, value) AS latency_seconds",
        "event_id / 3e6 AS estimated_cost_usd",
        "if(event_type = 'error', 'error', 'success') AS status",
        "if(event_type = 'error', 'failed', NULL) AS error_message",
    )
    total = total_tokens(
        safe_number(F.col("reported"), T.StringType()),
        safe_number(F.col("prompt_tokens"), T.StringType()),
        safe_number(F.col("completion_tokens"), T.StringType()),
    )
    return ops.normalize_run_rows(calls.withColumn("total_tokens", total), ["positive"])


# Comparison ----------------------------------------------------------------


def _pair(spark, sf_dir, name="run1"):
    return ops.align_pair(t.truth(spark, sf_dir), t.run(spark, sf_dir, name), LABELS)


def compare_metrics(spark, sf_dir):
    left, right = t.truth(spark, sf_dir), t.run(spark, sf_dir, "run1")
    labels = ops.pair_labels(left, right)
    return ops.compare_metrics(ops.align_pair(left, right, labels), labels).drop("label_pos")


def confusion_counts(spark, sf_dir):
    return ops.confusion_counts(_pair(spark, sf_dir), LABELS).drop("label_pos")


def compare_keeping_suffixes(spark, sf_dir):
    """No deduplication: repeated IDs meet many-to-many, counted by weight."""
    rule = IdRule(suffixes=("_1.nii.gz",), keep_reconstruction_suffix=True)
    left = t.line_truth(spark, sf_dir)
    right = t.line_runs(spark, sf_dir)["run1"]
    aligned = ops.align_pair(left, right, t.LI_LABELS, rule=rule)
    return ops.compare_metrics(aligned, t.LI_LABELS).drop("label_pos")


def compare_run_summary(spark, sf_dir):
    table = ops.pair_table(t.truth(spark, sf_dir), t.run(spark, sf_dir, "run1"), LABELS)
    summary = ops.compare_summary(table, LABELS)
    return summary.withColumn("labels_compared", F.array_join("labels_compared", ","))


def compare_many_labels(spark, sf_dir):
    """Eighteen labels; the plan has the same shape as for two."""
    docs = t.table(spark, sf_dir, "documents")
    name = "concat('doc_', doc_id, '_1.nii.gz') AS VolumeName"
    left = docs.selectExpr("doc_id AS _ord", name, *[f"cast(n_chars % {i} = 0 AS int) AS l{i}" for i in range(2, 20)])
    right = docs.selectExpr("doc_id AS _ord", name, *[f"cast(doc_id % {i} = 0 AS int) AS l{i}" for i in range(2, 20)])
    labels = [f"l{i}" for i in range(2, 20)]
    return ops.compare_metrics(ops.align_pair(left, right, labels), labels).drop("label_pos")


def compare_workflow(spark, sf_dir):
    result = plans.compare_runs(t.truth(spark, sf_dir), t.run(spark, sf_dir, "run1"))
    return result.evaluation_metrics.drop("label_pos")


def compare_workflow_discrepancies(spark, sf_dir):
    return plans.compare_runs(t.truth(spark, sf_dir), t.run(spark, sf_dir, "run1")).discrepancies


def agree_workflow(spark, sf_dir):
    return plans.agree_runs(t.runs(spark, sf_dir), LABELS).pairwise_agreement.drop("pair_pos", "label_pos")


def ensemble_workflow(spark, sf_dir):
    return plans.ensemble_runs(t.runs(spark, sf_dir), LABELS, strategies=["majority"]).consensus["consensus_majority"]


def unmatched_ids(spark, sf_dir):
    return ops.unmatched_ids(t.truth(spark, sf_dir), t.run(spark, sf_dir, "run1"))


def discrepancies(spark, sf_dir):
    return ops.discrepancies(_pair(spark, sf_dir), LABELS)


def discrepancies_with_report(spark, sf_dir):
    texts = t.reports(spark, sf_dir).select("VolumeName", "report_text")
    aligned = _pair(spark, sf_dir).join(texts, "VolumeName")
    return ops.discrepancies(aligned, LABELS, report_column="report_text")


def discrepancy_summary(spark, sf_dir):
    return ops.discrepancy_summary(discrepancies(spark, sf_dir))


def discrepancy_totals(spark, sf_dir):
    return ops.discrepancy_totals(discrepancy_summary(spark, sf_dir))


def top_discrepancies(spark, sf_dir):
    return ops.top_rows(discrepancy_summary(spark, sf_dir), 3)


def metrics_mean_std(spark, sf_dir):
    return ops.metrics_mean_std(ops.compare_many(t.truth(spark, sf_dir), t.runs(spark, sf_dir), LABELS))


def compare_many_runs(spark, sf_dir):
    """Three runs against the truth; the second one lacks a third of the IDs."""
    runs = t.runs(spark, sf_dir)
    runs["run2"] = runs["run2"].where("_ord % 3 > 0")
    return ops.compare_many(t.truth(spark, sf_dir), runs, LABELS).drop("label_pos")


def compare_by_language_and_source(spark, sf_dir):
    """Metrics for each language and source, each alone, and overall."""
    about = t.table(spark, sf_dir, "documents").selectExpr("concat('doc_', doc_id) AS VolumeName", "lang", "source")
    aligned = _pair(spark, sf_dir).join(about, "VolumeName")
    return ops.compare_by(aligned, LABELS, ["lang", "source"]).withColumnRenamed("_level", "level").drop("label_pos")


def metrics_files_mean_std(spark, sf_dir):
    """The same through metric files: written per run, found by glob, stacked by name."""
    folder = t.scratch(spark, "metrics")
    for name in RUNS:
        metrics = ops.compare_metrics(_pair(spark, sf_dir, name), LABELS).drop("label_pos")
        sources.write_table(metrics.coalesce(1), f"{folder}/{name}", "csv")
    return ops.metrics_mean_std(sources.read_metrics(spark, glob=f"{folder}/**/*.csv"))


# Agreement and consensus ----------------------------------------------------


def align_runs(spark, sf_dir):
    return ops.align_runs(t.runs(spark, sf_dir), LABELS)


def align_runs_stored(spark, sf_dir):
    """The three runs stored by ID, then aligned without a shuffle."""
    stored = {}
    for name, run in t.runs(spark, sf_dir).items():
        place = t.scratch(spark, name)
        stored[name] = sources.store_run(run, place.rsplit("/", 1)[1].replace("-", "_"), place, LABELS, buckets=8)
    return sources.align_stored(stored, LABELS)


def _votes(spark, sf_dir):
    return ops.run_votes(align_runs(spark, sf_dir), RUNS, LABELS)


def pairwise_agreement(spark, sf_dir):
    return ops.pairwise_agreement(_votes(spark, sf_dir), RUNS).drop("pair_pos", "label_pos")


def pairwise_agreement_summary(spark, sf_dir):
    pairwise = ops.pairwise_agreement(_votes(spark, sf_dir), RUNS)
    return ops.pairwise_summary(pairwise).drop("pair_pos")


def all_sets_agreement(spark, sf_dir):
    return ops.all_sets_agreement(_votes(spark, sf_dir), RUNS).drop("label_pos")


def agreement_run_summary(spark, sf_dir):
    summary = ops.agreement_summary(_votes(spark, sf_dir), RUNS, LABELS)
    return summary.withColumns(
        {
            "set_names": F.array_join("set_names", ","),
            "labels_compared": F.array_join("labels_compared", ","),
        }
    )


def _consensus(strategy):
    def query(spark, sf_dir):
        return ops.consensus(align_runs(spark, sf_dir), RUNS, LABELS, strategy)

    query.__doc__ = f"Consensus labels by {strategy}."
    return query


def consensus_run_summary(spark, sf_dir):
    return ops.consensus_summary(_votes(spark, sf_dir), RUNS).drop("strategy_pos")


# Preparation and sampling ---------------------------------------------------


def unique_scans(spark, sf_dir):
    raw = t.reconstructions(spark, sf_dir)
    return ops.unique_scans(raw, ["Findings", "Impressions"], ["lang", "not there"])


def stratified_allocation(spark, sf_dir):
    return ops.stratified_allocation(t.table(spark, sf_dir, "labels"), LABELS, 100)


def stratified_sample(spark, sf_dir):
    return ops.stratified_sample(t.table(spark, sf_dir, "labels"), LABELS, 100, "doc_id")


def stratified_sample_lines(spark, sf_dir):
    """The same on a table with very unequal strata."""
    rows = t.table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey", "cast(o_orderstatus = 'P' AS int) AS pending", "cast(o_totalprice >= 400000 AS int) AS big"
    )
    return ops.stratified_sample(rows, ["pending", "big"], 500, "o_orderkey", seed=7)


def label_prevalence(spark, sf_dir):
    df = t.table(spark, sf_dir, "labels")
    sample = ops.stratified_sample(df, LABELS, 100, "doc_id")
    return ops.label_prevalence({"input": df, "sample": sample}, LABELS).drop("label_pos")


def sample_rows(spark, sf_dir):
    return ops.sample_rows(t.table(spark, sf_dir, "labels"), 50, "doc_id")


def _half_keyed(spark, sf_dir):
    """Labelled documents of which every second one has no key."""
    return t.table(spark, sf_dir, "labels").selectExpr(
        "if(doc_id % 2 = 0, doc_id, NULL) AS key", "doc_id", "quality", "toxic"
    )


def stratified_sample_null_keys(spark, sf_dir):
    return ops.stratified_sample(_half_keyed(spark, sf_dir), LABELS, 100, "key")


def sample_rows_large(spark, sf_dir):
    """A large sample by a key that repeats, and is missing for one row in seven or so."""
    rows = t.table(spark, sf_dir, "lineitem").selectExpr(
        "if(l_linenumber = 1, NULL, l_partkey) AS key", "l_orderkey", "l_linenumber", "l_suppkey"
    )
    return ops.sample_rows(rows, 20_000, "key")


def top_up(spark, sf_dir):
    rows = _half_keyed(spark, sf_dir)
    return ops.top_up(rows, rows.where("doc_id % 10 < 2"), 150, "key")


def _labelled_reports(spark, sf_dir):
    labels = t.table(spark, sf_dir, "labels").withColumnRenamed("doc_id", "_ord")
    return t.reports(spark, sf_dir).join(labels, "_ord", "left")


def format_examples(spark, sf_dir):
    return ops.format_examples(_labelled_reports(spark, sf_dir), LABELS, n=3)


def format_examples_at(spark, sf_dir):
    return ops.format_examples(_labelled_reports(spark, sf_dir), LABELS, positions=[42, 7, 10**12, 7])


# Prompts, responses, cost ---------------------------------------------------


def report_hashes(spark, sf_dir):
    rows = t.reports(spark, sf_dir)
    return rows.select("VolumeName", report_hash(F.col("report_text")).alias("report_hash"))


def prompt_messages(spark, sf_dir):
    messages = build_messages(F.col("report_text"), t.PROMPT)
    listed = t.reports(spark, sf_dir).select("VolumeName", F.posexplode(messages).alias("pos", "m"))
    return listed.select("VolumeName", "pos", "m.role", "m.content")


def prompt_messages_one_label(spark, sf_dir):
    messages = build_messages(F.col("report_text"), t.PROMPT, " mentions the ")
    listed = t.reports(spark, sf_dir).select("VolumeName", F.posexplode(messages).alias("pos", "m"))
    return listed.select("VolumeName", "pos", "m.role", "m.content")


def _parsed(spark, sf_dir):
    body = t.responses(spark, sf_dir).withColumn("body", strip_code_fence(F.col("content")))
    return body.withColumn("parsed", parse_object(F.col("body")))


def parse_responses(spark, sf_dir):
    message = response_error(F.col("body"), F.col("parsed"))
    return _parsed(spark, sf_dir).select(
        "event_id",
        message.alias("error_message"),
        F.when(message == "", "success").otherwise("error").alias("status"),
        label_value(F.col("parsed"), F.lit("k")).alias("k"),
    )


def normalize_binary(spark, sf_dir):
    """The stored JSON of every event, and beside it a body with another type of value."""
    body = F.expr(
        "CASE event_id % 7 WHEN 0 THEN '{}' WHEN 1 THEN concat('{\"k\": ', value, '}')"
        " WHEN 2 THEN concat('{\"k\": \"', event_id % 3, '\"}')"
        " WHEN 3 THEN concat('{\"k\": ', event_type = 'view', '}')"
        " WHEN 4 THEN '{\"k\": null, \"K\": \"Positive\"}' WHEN 5 THEN '{\"k\": [1]}'"
        " ELSE concat('{\"k\": 1, \"k\": ', event_id % 5 - 2, '}') END"
    )
    events = t.table(spark, sf_dir, "events").select(
        "event_id", parse_object(F.col("props")).alias("stored"), parse_object(body).alias("other")
    )
    return events.select("event_id", *[label_value(F.col(c), F.lit("k")).alias(f"{c}_k") for c in ("stored", "other")])


def label_in_force(spark, sf_dir):
    """Every event with the amount of its user's last purchase at or before it."""
    events = t.table(spark, sf_dir, "events")
    calls = events.where("event_type <> 'purchase'").select("event_id", "user_id", "event_type", "ts")
    states = events.where("event_type = 'purchase'").selectExpr("user_id", "ts", "value AS in_force", "event_id AS state_id")
    return ops.asof_join(calls, states, "user_id", "ts", ["in_force", "state_id"], ranges=16).drop("ts")


def sketched_overlap(spark, sf_dir):
    """IDs of the truth and of a run that lacks some, counted from sketches stored per part."""
    folders = []
    for name, df in (("truth", t.truth(spark, sf_dir)), ("run", t.run(spark, sf_dir, "run1").where("_ord % 3 > 0"))):
        folders.append(t.scratch(spark, f"sketch-{name}"))
        parts = ops.id_sketches(df.withColumn("part", F.col("_ord") % 5), ["part"], log_ids=20)
        sources.write_table(parts, folders[-1])
    return ops.overlap(*[spark.read.parquet(folder) for folder in folders], log_ids=20)


def sketched_quantiles(spark, sf_dir):
    """Quantiles of event values per type from sketches stored per type and user group; exact at this size."""
    events = t.table(spark, sf_dir, "events").withColumn("part", F.col("user_id") % 3)
    folder = t.scratch(spark, "quantiles")
    sources.write_table(ops.value_sketches(events, "value", ["event_type", "part"], k=65_535), folder)
    return ops.quantiles(spark.read.parquet(folder), [0.5, 0.9, 0.99], ["event_type"]).withColumnsRenamed(
        {"q0.5": "q50", "q0.9": "q90", "q0.99": "q99"}
    )


def written_results(spark, sf_dir):
    """Discrepancies written as CSV and metrics as Parquet, each replaced once and read again; a summary as JSON."""
    folder = t.scratch(spark, "results")
    wrong, metrics = discrepancies(spark, sf_dir), compare_metrics(spark, sf_dir)
    for rows in (wrong.limit(1), wrong):
        sources.write_table(rows, f"{folder}/wrong", "csv")
    for rows in (metrics.limit(1), metrics):
        sources.write_table(rows, f"{folder}/metrics")
    sources.write_summary(metrics.agg(F.sum("tp").alias("tp_sum"), F.lit(None).cast("string").alias("note")), f"{folder}/summary")
    counted = spark.read.option("header", True).csv(f"{folder}/wrong").groupBy("Label").agg(F.count("*").alias("wrong"))
    summary = spark.read.json(f"{folder}/summary")
    told = spark.read.parquet(f"{folder}/metrics").withColumnRenamed("label", "name")
    joined = told.join(counted, F.col("name") == F.col("Label"), "left").select(F.col("name").alias("label"), "tp", "fp", "fn", "tn", "wrong")
    assert summary.columns == ["tp_sum"]
    return joined.crossJoin(summary)


def metrics_listed_twice(spark, sf_dir):
    """Metric files named by a list and found by a pattern, some both ways: each counts once."""
    folder = t.scratch(spark, "listed")
    for name in RUNS:
        metrics = ops.compare_metrics(_pair(spark, sf_dir, name), LABELS).drop("label_pos")
        sources.write_table(metrics.coalesce(1), f"{folder}/{name}", "csv")
    files = sources.list_files(spark, f"{folder}/**/*.csv")
    stacked = sources.read_metrics(spark, paths=[*files[:2], files[0]], glob=f"{folder}/**/*.csv")
    return ops.metrics_mean_std(stacked)


def shared_columns(spark, sf_dir):
    """Labels that runs spelt unlike each other share, after a table that lacks a column is refused."""
    left = t.truth(spark, sf_dir).withColumnsRenamed({"quality": "Quality"}).withColumn("only here", F.lit(1))
    right = t.run(spark, sf_dir, "run1").withColumnsRenamed({"toxic": "TOXIC", "VolumeName": "volumename"})
    try:
        ops.require_columns(right, ["VolumeName", "Quality"])
    except ValueError:
        labels = ops.shared_labels([left, right])
        return ops.compare_metrics(ops.align_pair(left, right, labels), labels).drop("label_pos")


def price_table(spark, sf_dir):
    """Line items as calls of a model per part, priced by a key per part whose price changed once."""
    lines = t.table(spark, sf_dir, "lineitem").selectExpr(
        "l_orderkey", "l_linenumber", "concat('Vendor/MODEL-', l_partkey, if(l_partkey % 3 = 0, '', '-turbo')) AS model",
        "l_shipdate AS called", "CAST(l_quantity AS BIGINT) * 1000 AS prompt_tokens", "l_suppkey AS completion_tokens",
    )
    early, late = "timestamp_ntz '1995-06-17 00:00:00'", "CAST(NULL AS timestamp_ntz)"
    key, rate = "concat('model-', p_partkey) AS model_key", "(p_partkey % 100) / 8.0D"
    prices = t.table(spark, sf_dir, "part").selectExpr(key, f"{rate} AS input_per_million", f"{rate} * 4 AS output_per_million", f"{late} AS valid_from", f"{early} AS valid_to")
    prices = prices.union(
        t.table(spark, sf_dir, "part").where("p_partkey % 5 > 0").selectExpr(key, f"{rate} / 2 AS input_per_million", f"{rate} AS output_per_million", f"{early} AS valid_from", f"{late} AS valid_to")
    )
    return ops.price_usage(lines, prices, at="called").drop("called")


MANY_RUNS = [f"m{i}" for i in range(64)]


def _many_votes(spark, sf_dir):
    """64 runs over all documents, side by side."""
    votes = [f"CAST((doc_id * {i + 3} + n_chars) % 7 < {2 + i % 4} AS INT) AS m{i}__quality" for i in range(64)]
    votes += [f"CAST((n_chars + {i}) % {2 + i % 9} = 0 AS INT) AS m{i}__toxic" for i in range(64)]
    return t.table(spark, sf_dir, "documents").selectExpr("doc_id", *votes)


def pairwise_agreement_many(spark, sf_dir):
    words = ops.bit_votes(_many_votes(spark, sf_dir), MANY_RUNS, LABELS)
    return ops.pairwise_agreement_bits(words, MANY_RUNS).drop("pair_pos", "label_pos")


def all_sets_agreement_many(spark, sf_dir):
    """64 runs whose first labels are alike on most rows."""
    votes = [f"CAST(n_chars % 5 = 0 OR doc_id % {50 + i} = 0 AS INT) AS m{i}__quality" for i in range(64)]
    votes += [f"CAST(n_chars % 3 > 0 AND n_chars % {60 + i} > 0 AS INT) AS m{i}__toxic" for i in range(64)]
    rows = t.table(spark, sf_dir, "documents").selectExpr("doc_id", *votes)
    words = ops.bit_votes(rows, MANY_RUNS, LABELS)
    return ops.all_sets_agreement_bits(words, MANY_RUNS, rows.count()).drop("label_pos")


def costs(spark, sf_dir):
    model, asked, told = (F.col(c) for c in ("model", "prompt_tokens", "completion_tokens"))
    cost = estimate_cost(model, asked, told, DEFAULT_PRICING)
    return t.usage(spark, sf_dir).withColumn("estimated_cost_usd", cost)


def combine_meta(spark, sf_dir):
    return ops.combine_meta(t.line_calls(spark, sf_dir), ["report"], F.col("position"))


# Labelling ------------------------------------------------------------------

_STABLE = [
    "VolumeName", "long text", "mentions the", "prompt_tokens", "completion_tokens", "total_tokens",
    "estimated_cost_usd", "model_version", "request_id", "retry_count", "report_hash", "status",
    "error_message",
]


def _label(spark, sf_dir, prompt=t.PROMPT, reports=None, flaky=False, **options):
    rows = reports if reports is not None else t.reports(spark, sf_dir)
    return ops.label_reports(
        rows,
        prompt,
        t.keyword_model(flaky),
        model="gpt-5-nano",
        pricing=DEFAULT_PRICING,
        wait_seconds=(0.0, 0.0),
        **options,
    )


def label_reports_multi(spark, sf_dir):
    return _label(spark, sf_dir).select(*_STABLE)


def label_reports_single(spark, sf_dir):
    return _label(spark, sf_dir, t.SINGLE_PROMPT).select(*_STABLE)


def label_reports_retry(spark, sf_dir):
    return _label(spark, sf_dir, flaky=True, max_retries=3).select(*_STABLE)


def skip_empty_reports(spark, sf_dir):
    blank = t.partly_blank_reports(spark, sf_dir)
    return _label(spark, sf_dir, reports=blank).select(*_STABLE)


def skip_empty_reports_single(spark, sf_dir):
    blank = t.partly_blank_reports(spark, sf_dir)
    return _label(spark, sf_dir, t.SINGLE_PROMPT, blank).select(*_STABLE)


def blank_reports(spark, sf_dir):
    rows = t.partly_blank_reports(spark, sf_dir)
    return rows.select("VolumeName", is_blank(F.col("report_text")).cast("int").alias("blank"))


def run_totals(spark, sf_dir):
    rows = _label(spark, sf_dir)
    return ops.run_totals(rows).drop("average_latency_seconds")


def eval_run_summary(spark, sf_dir):
    """Summary of an evaluation over token usage and the comparison's macro row."""
    rows = t.usage(spark, sf_dir).select(
        F.when(F.col("model") == "unknown", "skipped").otherwise("success").alias("status"),
        F.col("completion_tokens").cast("double").alias("latency_seconds"),
        (F.col("prompt_tokens") / F.lit(1024.0)).alias("estimated_cost_usd"),
    )
    metrics = ops.with_averages(ops.binary_metrics(ops.confusion_counts(_pair(spark, sf_dir), LABELS)), False)
    return ops.evaluation_summary(rows, metrics, "gpt-5-nano")


def evaluation_metrics(spark, sf_dir):
    """Label the documents that have truth and score them."""
    labels = t.table(spark, sf_dir, "labels").selectExpr(
        "doc_id AS _ord", "quality AS `long text`", "toxic AS `mentions the`"
    )
    rows = t.reports(spark, sf_dir).join(labels, "_ord")
    result = plans.evaluate_prompt(
        rows, t.PROMPT, t.keyword_model(), model="gpt-5-nano", order_by="_ord", wait_seconds=(0.0, 0.0)
    )
    return result.evaluation_metrics.drop("label_pos")


def evaluate_unordered(spark, sf_dir):
    """The same for rows without any order of their own."""
    labels = t.table(spark, sf_dir, "labels").selectExpr(
        "doc_id AS _ord", "quality AS `long text`", "toxic AS `mentions the`"
    )
    rows = t.reports(spark, sf_dir).join(labels, "_ord").drop("_ord").dropDuplicates(["VolumeName"])
    result = plans.evaluate_prompt(rows, t.PROMPT, t.keyword_model(), model="gpt-5-nano", wait_seconds=(0.0, 0.0))
    return result.evaluation_metrics.drop("label_pos")


def call_log(spark, sf_dir):
    calls = ops.call_model(
        t.reports(spark, sf_dir), t.PROMPT, t.keyword_model(), model="gpt-5-nano"
    )
    log = ops.call_log(calls, t.PROMPT, "gpt-5-nano")
    return log.select(
        "VolumeName", "event", "model", F.array_join("labels", ",").alias("labels"), "report_hash",
        "messages_count", "request_id", "model_version", "content_length", "finish_reason",
        F.col("tool_calls_present").cast("int").alias("tool_calls_present"), "status", "error_message",
        "prompt_tokens", "completion_tokens", "total_tokens",
    )


# Resume ---------------------------------------------------------------------


def _resume(spark, sf_dir, **options):
    return ops.resume_match(t.reports(spark, sf_dir), t.history(spark, sf_dir), **options)


def resume_match(spark, sf_dir):
    """Every report with how it is served and the earlier row it takes."""
    found = _resume(spark, sf_dir)
    reused = found.reused.select("VolumeName", "reuse", "quality", "toxic", "prompt_tokens", "status")
    todo = found.todo.select("VolumeName", F.lit("none").alias("reuse"))
    return reused.unionByName(todo, allowMissingColumns=True)


def resume_match_strict(spark, sf_dir):
    """Same text required, errored rows labelled again."""
    found = _resume(spark, sf_dir, require_same_hash=True, retry_status=("error",))
    reused = found.reused.select("VolumeName", "reuse", "quality", "toxic", "prompt_tokens", "status")
    todo = found.todo.select("VolumeName", F.lit("none").alias("reuse"))
    return reused.unionByName(todo, allowMissingColumns=True)


def resume_stats(spark, sf_dir):
    return _resume(spark, sf_dir).stats


def resume_batch(spark, sf_dir):
    """Reused and new rows together in the run schema."""
    prior = t.history(spark, sf_dir).selectExpr(
        "_ord", "VolumeName", "quality AS `long text`", "toxic AS `mentions the`", "report_hash", "status"
    )
    rows, _ = plans.resume_batch(
        t.reports(spark, sf_dir), prior, t.PROMPT, t.keyword_model(), wait_seconds=(0.0, 0.0)
    )
    return rows.select("VolumeName", "reuse", "long text", "mentions the", "report_hash", "status")


def generate_labels_unordered(spark, sf_dir):
    """Every report comes out once, with its own text, whatever order it was read in."""
    prior = t.history(spark, sf_dir).selectExpr(
        "_ord", "VolumeName", "quality AS `long text`", "toxic AS `mentions the`", "report_hash", "status"
    )
    rows = t.reports(spark, sf_dir).drop("_ord").dropDuplicates(["VolumeName"])
    run = plans.generate_labels(rows, t.PROMPT, t.keyword_model(), history=prior, wait_seconds=(0.0, 0.0))
    return run.labels.select("VolumeName", "report_hash")


def generate_labels_sliced(spark, sf_dir):
    """Labelled and committed in three parts."""
    run = plans.generate_labels(
        t.reports(spark, sf_dir), t.PROMPT, t.keyword_model(), model="gpt-5-nano", pricing=DEFAULT_PRICING,
        output=t.scratch(spark, "sliced"), slices=3, matching={"order_by": "_ord"}, wait_seconds=(0.0, 0.0),
    )
    return run.labels.select(*_STABLE)


def generate_labels_restarted(spark, sf_dir):
    """In five parts, asked for again in three: refused, then labelled anew; then once more, with nothing left to do."""
    folder = t.scratch(spark, "restarted")

    def run(**settings):
        return plans.generate_labels(
            t.reports(spark, sf_dir), t.PROMPT, t.keyword_model(), model="gpt-5-nano", pricing=DEFAULT_PRICING,
            output=folder, matching={"order_by": "_ord"}, wait_seconds=(0.0, 0.0), **settings,
        )

    run(slices=5)
    try:
        run(slices=3)
    except ValueError:
        run(slices=3, on_change="restart")
    return run(slices=3).labels.select(*_STABLE)


def write_labels(spark, sf_dir):
    """A run table written, replaced and read again."""
    folder = t.scratch(spark, "labels")
    sources.write_labels(t.run(spark, sf_dir, "run2"), folder)
    sources.write_labels(t.run(spark, sf_dir, "run1").drop("_ord"), folder)
    return sources.read_table(spark, folder).select("VolumeName", "quality", "toxic")


def dedupe_over_files(spark, sf_dir):
    """The first row of every ID over three files of unlike size, in order of the files."""
    folder = t.scratch(spark, "files")
    part = "CASE WHEN doc_id % 10 = 0 THEN 0 WHEN doc_id % 3 = 0 THEN 1 ELSE 2 END"
    rows = t.table(spark, sf_dir, "documents").selectExpr(
        f"{part} AS part", "concat('scan_', doc_id % 97) AS VolumeName", "doc_id", "n_chars"
    )
    ordered = rows.repartition("part").sortWithinPartitions("part", "doc_id")
    ordered.write.partitionBy("part").parquet(folder)
    kept = ops.dedupe_first(sources.read_table(spark, folder, ["VolumeName", "doc_id", "n_chars"]))
    return kept.select("VolumeName", "doc_id", "n_chars")


def incremental_label(spark, sf_dir):
    """Two arrivals: the documents with truth, then all of them."""
    folder = t.scratch(spark, "arrivals")
    known = t.table(spark, sf_dir, "labels").select(F.col("doc_id").alias("_ord"))
    everything = t.reports(spark, sf_dir)
    schema = everything.schema
    for part, rows in enumerate((everything.join(known, "_ord", "left_semi"), everything)):
        arrived = rows.select(*schema.names)
        arrived.write.parquet(f"{folder}/in/part={part}")
        stream = spark.readStream.schema(schema).parquet(f"{folder}/in/part=*")
        streaming.incremental_label(
            stream,
            f"{folder}/out",
            f"{folder}/checkpoint",
            t.PROMPT,
            t.keyword_model(),
            order_by=ORDER,
            wait_seconds=(0.0, 0.0),
        ).awaitTermination()
    done = spark.read.parquet(f"{folder}/out")
    return done.select("VolumeName", "long text", "mentions the", "report_hash", "status")


def incremental_label_state(spark, sf_dir):
    """The same two arrivals, matched by the stream's own state; of equal texts the first is asked for."""
    folder = t.scratch(spark, "state")
    known = t.table(spark, sf_dir, "labels").select(F.col("doc_id").alias("_ord"))
    everything = t.reports(spark, sf_dir)
    schema = everything.schema
    for part, rows in enumerate((everything.join(known, "_ord", "left_semi"), everything)):
        rows.select(*schema.names).write.parquet(f"{folder}/in/part={part}")
        stream = spark.readStream.schema(schema).parquet(f"{folder}/in/part=*")
        streaming.incremental_label_state(
            stream, f"{folder}/out", f"{folder}/checkpoint", t.PROMPT, t.keyword_model(), order_by=ORDER, wait_seconds=(0.0, 0.0)
        ).awaitTermination()
    done = spark.read.parquet(f"{folder}/out")
    return done.select("VolumeName", "long text", "mentions the", "report_hash", "status", "reuse", F.col("batch_id").cast("bigint").alias("batch_id"))


# Large label tables ---------------------------------------------------------


def bench_compare_li(spark, sf_dir):
    left, right = t.line_truth(spark, sf_dir), t.line_runs(spark, sf_dir)["run1"]
    aligned = ops.align_pair(left, right, t.LI_LABELS)
    return ops.compare_metrics(aligned, t.LI_LABELS).drop("label_pos")


def bench_agreement_li(spark, sf_dir):
    aligned = ops.align_runs(t.line_runs(spark, sf_dir), t.LI_LABELS)
    votes = ops.run_votes(aligned, RUNS, t.LI_LABELS)
    return ops.pairwise_agreement(votes, RUNS).drop("pair_pos", "label_pos")


def bench_consensus_li(spark, sf_dir):
    aligned = ops.align_runs(t.line_runs(spark, sf_dir), t.LI_LABELS)
    return ops.consensus(aligned, RUNS, t.LI_LABELS, "majority")


QUERIES = {
    "scan_reports": scan_reports,
    "normalize_ids": normalize_ids,
    "dedupe_first": dedupe_first,
    "coerce_binary": coerce_binary,
    "normalize_run_rows": normalize_run_rows,
    "compare_metrics": compare_metrics,
    "confusion_counts": confusion_counts,
    "compare_keeping_suffixes": compare_keeping_suffixes,
    "compare_run_summary": compare_run_summary,
    "unmatched_ids": unmatched_ids,
    "discrepancies": discrepancies,
    "discrepancies_with_report": discrepancies_with_report,
    "discrepancy_summary": discrepancy_summary,
    "discrepancy_totals": discrepancy_totals,
    "top_discrepancies": top_discrepancies,
    "metrics_mean_std": metrics_mean_std,
    "compare_many_runs": compare_many_runs,
    "compare_by_language_and_source": compare_by_language_and_source,
    "metrics_files_mean_std": metrics_files_mean_std,
    "align_runs": align_runs,
    "pairwise_agreement": pairwise_agreement,
    "pairwise_agreement_summary": pairwise_agreement_summary,
    "all_sets_agreement": all_sets_agreement,
    "agreement_run_summary": agreement_run_summary,
    "consensus_any_positive": _consensus("any_positive"),
    "consensus_majority": _consensus("majority"),
    "consensus_unanimity": _consensus("unanimity"),
    "consensus_run_summary": consensus_run_summary,
    "unique_scans": unique_scans,
    "stratified_allocation": stratified_allocation,
    "stratified_sample": stratified_sample,
    "stratified_sample_lines": stratified_sample_lines,
    "stratified_sample_null_keys": stratified_sample_null_keys,
    "sample_rows_large": sample_rows_large,
    "top_up": top_up,
    "compare_many_labels": compare_many_labels,
    "compare_workflow": compare_workflow,
    "compare_workflow_discrepancies": compare_workflow_discrepancies,
    "agree_workflow": agree_workflow,
    "ensemble_workflow": ensemble_workflow,
    "evaluate_unordered": evaluate_unordered,
    "generate_labels_unordered": generate_labels_unordered,
    "generate_labels_sliced": generate_labels_sliced,
    "generate_labels_restarted": generate_labels_restarted,
    "write_labels": write_labels,
    "dedupe_over_files": dedupe_over_files,
    "label_prevalence": label_prevalence,
    "sample_rows": sample_rows,
    "format_examples": format_examples,
    "format_examples_at": format_examples_at,
    "report_hash": report_hashes,
    "prompt_messages": prompt_messages,
    "prompt_messages_one_label": prompt_messages_one_label,
    "parse_responses": parse_responses,
    "normalize_binary": normalize_binary,
    "label_in_force": label_in_force,
    "written_results": written_results,
    "metrics_listed_twice": metrics_listed_twice,
    "shared_columns": shared_columns,
    "align_runs_stored": align_runs_stored,
    "sketched_overlap": sketched_overlap,
    "sketched_quantiles": sketched_quantiles,
    "price_table": price_table,
    "pairwise_agreement_many": pairwise_agreement_many,
    "all_sets_agreement_many": all_sets_agreement_many,
    "estimate_cost": costs,
    "combine_meta": combine_meta,
    "label_reports_multi": label_reports_multi,
    "label_reports_single": label_reports_single,
    "label_reports_retry": label_reports_retry,
    "skip_empty_reports": skip_empty_reports,
    "skip_empty_reports_single": skip_empty_reports_single,
    "blank_reports": blank_reports,
    "run_totals": run_totals,
    "eval_run_summary": eval_run_summary,
    "evaluation_metrics": evaluation_metrics,
    "call_log": call_log,
    "resume_match": resume_match,
    "resume_match_strict": resume_match_strict,
    "resume_stats": resume_stats,
    "resume_batch": resume_batch,
    "incremental_label": incremental_label,
    "incremental_label_state": incremental_label_state,
    "bench_compare_li": bench_compare_li,
    "bench_agreement_li": bench_agreement_li,
    "bench_consensus_li": bench_consensus_li,
}
