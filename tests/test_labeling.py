import hashlib
import json
import shutil

import pytest
from pyspark.sql import functions as F

from tallymark import PromptSpec, plans
from tallymark import operators as ops

PRICING = {"gpt-5-nano": {"input_per_million": 0.05, "output_per_million": 0.4}}
MULTI = PromptSpec("You are a test model.", ("Label_A", "Label_B"))
SINGLE = PromptSpec("You are a test model.", ("Label_A", "Label_B"), "single")


def scripted(answers):
    """Factory of a model that answers by the text found in the user message."""

    def factory():
        def call(messages):
            user = messages[-1]["content"]
            for text, answer in answers.items():
                if text in user:
                    if isinstance(answer, Exception):
                        raise answer
                    return answer
            raise ValueError("unexpected report")

        return call

    return factory


def answer(labels, prompt=100, completion=10, **more):
    content = labels if isinstance(labels, str) else json.dumps(labels)
    return {"content": content, "prompt_tokens": prompt, "completion_tokens": completion, **more}


def reports(spark, *rows):
    data = [(v, t, i) for i, (v, t) in enumerate(rows)]
    return spark.createDataFrame(data, "VolumeName string, report_text string, _ord bigint")


def label(spark, df, prompt, answers, **options):
    options = {"wait_seconds": (0.0, 0.0), "model": "gpt-5-nano", "pricing": PRICING, **options}
    rows = ops.label_reports(df, prompt, scripted(answers), **options)
    return {r["VolumeName"]: r.asDict() for r in rows.collect()}


def test_multi_mode_rows(spark):
    df = reports(spark, ("vol-1", "Report alpha"), ("vol-2", "Report beta"))
    got = label(
        spark,
        df,
        MULTI,
        {
            "alpha": answer({"Label_A": 1, "Label_B": 0}, 100, 10, request_id="req-1", model_version="mock-1"),
            "beta": answer({"label_a": 0, "LABEL_B": "yes"}, 200, 40, total_tokens=241),
        },
    )
    one, two = got["vol-1"], got["vol-2"]
    assert (one["Label_A"], one["Label_B"], two["Label_A"], two["Label_B"]) == (1, 0, 0, 1)
    assert one["estimated_cost_usd"] == 0.000009
    assert (one["total_tokens"], two["total_tokens"]) == (110, 241)
    assert (one["request_id"], one["model_version"], two["model_version"]) == ("req-1", "mock-1", "gpt-5-nano")
    assert one["status"] == "success" and one["retry_count"] == 1
    assert one["report_hash"] == hashlib.sha256(b"Report alpha").hexdigest()
    assert one["started_at_utc"].endswith("Z") and one["started_at_utc"] <= one["ended_at_utc"]
    assert len(one["started_at_utc"]) == len("2025-01-01T00:00:00.000Z")


def test_blank_reports_are_not_sent(spark):
    df = reports(spark, ("vol-1", None), ("vol-2", "  \n"))
    for prompt in (MULTI, SINGLE):
        got = label(spark, df, prompt, {"": RuntimeError("called")})
        for row in got.values():
            assert (row["status"], row["Label_A"], row["Label_B"]) == ("skipped", 0, 0)
            assert (row["retry_count"], row["model_version"], row["error_message"]) == (0, "", "")
        assert got["vol-1"]["report_hash"] == "" and got["vol-2"]["report_hash"] != ""


def test_failures_give_zeros(spark):
    df = reports(spark, ("broken", "r-json"), ("down", "r-down"), ("list", "r-list"), ("empty", "r-empty"))
    got = label(
        spark,
        df,
        MULTI,
        {
            "r-json": answer("{not json", 60, 5, request_id="q"),
            "r-down": ValueError("API Down"),
            "r-list": answer("[1]"),
            "r-empty": answer("  "),
        },
        max_retries=3,
    )
    assert {r["status"] for r in got.values()} == {"error"}
    assert {(r["Label_A"], r["Label_B"]) for r in got.values()} == {(0, 0)}
    broken, down, listed, empty = (got[k] for k in ("broken", "down", "list", "empty"))
    assert (broken["error_message"], broken["prompt_tokens"], broken["request_id"]) == ("Malformed JSON response", 60, "q")
    assert (down["error_message"], down["prompt_tokens"], down["retry_count"]) == ("API Down", 0, 1)
    assert listed["error_message"] == "'list' object has no attribute 'items'"
    assert (empty["error_message"], empty["retry_count"]) == ("Empty response from LLM", 3)


def test_retry_counts_attempts(spark):
    reply = answer({"Label_A": 1, "Label_B": 0}, 60, 10)

    def factory():
        left = [TimeoutError("rate limit")]

        def call(messages):
            if left:
                raise left.pop()
            return reply

        return call

    df = reports(spark, ("v", "text")).coalesce(1)
    row = ops.label_reports(df, MULTI, factory, wait_seconds=(0.0, 0.0)).first()
    assert (row["retry_count"], row["status"], row["total_tokens"], row["Label_A"]) == (2, "success", 70, 1)

    def always():
        def call(messages):
            raise ConnectionError("gone")

        return call

    row = ops.label_reports(df, MULTI, always, max_retries=4, wait_seconds=(0.0, 0.0)).first()
    assert (row["retry_count"], row["status"], row["error_message"]) == (4, "error", "gone")


def test_single_mode_asks_per_label(spark):
    df = reports(spark, ("vol", "Report gamma")).repartition(2)
    got = label(
        spark,
        df,
        SINGLE,
        {
            "- Label_A\nReturn": answer({"Label_A": 1, "Label_B": 1}, 50, 10, request_id="req-a", model_version="mock-a"),
            "- Label_B\nReturn": answer({"Label_B": 0}, 20, 5, request_id="req-b", model_version="mock-b"),
        },
        partitions=4,
    )
    row = got["vol"]
    assert (row["Label_A"], row["Label_B"]) == (1, 0)
    assert (row["prompt_tokens"], row["completion_tokens"], row["total_tokens"]) == (70, 15, 85)
    assert (row["request_id"], row["model_version"], row["retry_count"]) == ("req-a | req-b", "mock-a | mock-b", 2)
    assert row["estimated_cost_usd"] == round(70 / 1e6 * 0.05 + 15 / 1e6 * 0.4, 8)


def calls(spark, *rows):
    fields = (
        "pos int, prompt_tokens bigint, completion_tokens bigint, total_tokens bigint, latency_seconds double,"
        " retry_count bigint, status string, error_message string, request_id string, model_version string,"
        " started_at_utc string, ended_at_utc string"
    )
    return spark.createDataFrame([("r", *row) for row in rows], "report string, " + fields)


def test_combine_meta(spark):
    df = calls(
        spark,
        (1, 20, 5, 25, 0.5, 2, "success", "", "req-b", "mock-b", "2025-01-01T00:00:02Z", "2025-01-01T00:00:03Z"),
        (0, 50, 10, 60, 0.25, 1, "success", "", "req-a", "mock-a", "2025-01-01T00:00:00Z", "2025-01-01T00:00:01Z"),
    )
    row = ops.combine_meta(df.repartition(2), ["report"], F.col("pos")).first()
    assert (row["total_tokens"], row["latency_seconds"], row["retry_count"], row["status"]) == (85, 0.75, 3, "success")
    assert (row["request_id"], row["model_version"]) == ("req-a | req-b", "mock-a | mock-b")
    assert (row["started_at_utc"], row["ended_at_utc"]) == ("2025-01-01T00:00:00Z", "2025-01-01T00:00:03Z")


@pytest.mark.parametrize(
    "statuses, expected",
    [
        (("success", "error"), "error"),
        (("skipped", "skipped"), "skipped"),
        (("skipped", "success"), "success"),
        (("skipped", ""), "skipped"),
        (("", None), "success"),
    ],
)
def test_combined_status(spark, statuses, expected):
    rows = [(i, 1, 1, None, 0.0, 1, s, "same", "", "m", "", None) for i, s in enumerate(statuses)]
    row = ops.combine_meta(calls(spark, *rows), ["report"], F.col("pos")).first()
    assert row["status"] == expected
    assert (row["error_message"], row["model_version"], row["started_at_utc"]) == ("same", "m", "")
    assert row["total_tokens"] == 0


def test_run_rows_have_the_fixed_schema(spark):
    df = spark.createDataFrame([("v", "1.9", None, "x")], "VolumeName string, L string, model_version string, latency_seconds string")
    out = ops.normalize_run_rows(df, ["L"])
    assert out.columns == ops.run_columns(["L"])
    row = out.first()
    assert (row["L"], row["model_version"], row["latency_seconds"], row["prompt_tokens"]) == (1, "", 0.0, 0)


def test_call_log_has_two_events_per_call(spark, tmp_path):
    df = reports(spark, ("a", "good"), ("b", "bad"), ("c", " "))
    made = ops.call_model(
        df, MULTI, scripted({"good": answer({"Label_A": 1}), "bad": ValueError("no")}), model="m", keep_request=True
    )
    log = ops.call_log(made, MULTI, "m", include_text=True)
    log.coalesce(1).write.json(str(tmp_path / "log"))
    lines = [json.loads(x) for f in (tmp_path / "log").glob("*.json") for x in f.read_text().splitlines()]
    events = {(x["VolumeName"], x["event"]): x for x in lines}
    assert set(events) == {(v, e) for v in "ab" for e in ("request", "response")}
    sent = events["a", "request"]
    assert sent["labels"] == ["Label_A", "Label_B"] and sent["messages_count"] == 2
    assert [m["role"] for m in sent["messages"]] == ["system", "user"] and "good" in sent["messages"][1]["content"]
    assert "status" not in sent
    assert events["a", "response"]["content"] == '{"Label_A": 1}'
    assert events["b", "response"]["error_message"] == "no" and events["b", "response"]["content_length"] == 0


def test_generate_labels_sums_up(spark, tmp_path):
    df = reports(spark, ("a", "one"), ("b", "two"), ("c", ""))
    run = plans.generate_labels(
        df,
        MULTI,
        scripted({"one": answer({"Label_A": 1}, 120, 30), "two": answer("junk", 80, 20)}),
        model="gpt-5-nano",
        pricing=PRICING,
        output=str(tmp_path / "labels"),
    )
    assert run.labels.columns == ops.run_columns(["Label_A", "Label_B"])
    totals = run.run_summary.first()
    assert (totals["total_reports"], totals["success"], totals["error"], totals["skipped"], totals["other"]) == (3, 1, 1, 1, 0)
    assert (totals["prompt_tokens"], totals["completion_tokens"], totals["average_attempts"]) == (200, 50, 1.0)
    assert totals["total_cost_usd"] == round(200 / 1e6 * 0.05 + 50 / 1e6 * 0.4, 8)
    with pytest.raises(ValueError, match="report_text"):
        plans.generate_labels(df.drop("report_text"), MULTI, scripted({}))


def test_evaluate_prompt_end_to_end(spark, rows):
    df = spark.createDataFrame(
        [("vol-1", "first", 1, 0, 0), ("vol-2", "second", 0, 1, 1)],
        "volumename string, Report_Text string, Label_A int, Label_B int, o bigint",
    )
    model = scripted(
        {"first": answer({"Label_A": 1, "Label_B": 1}, 100, 20), "second": answer({"Label_A": 0, "Label_B": 0}, 150, 30)}
    )
    result = plans.evaluate_prompt(df, MULTI, model, model="gpt-5-nano", pricing=PRICING, order_by="o")
    metrics = {r["label"]: r for r in result.evaluation_metrics.collect()}
    assert (metrics["Label_A"]["f1"], metrics["Label_B"]["f1"]) == (1.0, 0.0)
    assert metrics["MACRO_AVERAGE"]["f1"] == 0.5 and "MICRO_AVERAGE" not in metrics
    assert rows(result.discrepancies) == [("vol-1", "Label_B", 1, 0, "first"), ("vol-2", "Label_B", 0, 1, "second")]
    summary = result.run_summary.first()
    assert (summary["total_reports"], summary["labeled_reports"], summary["coverage_percent"]) == (2, 2, 100.0)
    assert summary["total_estimated_cost_usd"] == round(0.000013 + 0.0000195, 6)
    assert summary["macro_f1"] == 0.5 and summary["model_version"] == "gpt-5-nano"
    assert sorted(c for c in result.evaluation_predictions.columns if c.startswith("pred_")) == ["pred_Label_A", "pred_Label_B"]
    assert "estimated_cost_usd" not in result.evaluation_predictions.columns

    again = plans.evaluate_prompt(
        df, MULTI, scripted({"": RuntimeError("called")}), pricing=PRICING, model="gpt-5-nano",
        order_by="o", history=result.evaluation_predictions,
    )
    assert rows(again.evaluation_metrics) == rows(result.evaluation_metrics)
    assert again.run_summary.first()["total_estimated_cost_usd"] == summary["total_estimated_cost_usd"]
    with pytest.raises(ValueError, match="Label_B"):
        plans.evaluate_prompt(df.drop("Label_B"), MULTI, model)


def test_calls_run_side_by_side(spark):
    """Calls wait for each other, so they only end if several are under way at once."""

    def factory():
        import threading

        meet = threading.Barrier(4, timeout=20)

        def call(messages):
            meet.wait()
            return {"content": '{"a": 1}', "request_id": messages[-1]["content"][-1:]}

        return call

    df = spark.createDataFrame([(i, f"v{i}", f"text {i}") for i in range(8)], "_ord bigint, VolumeName string, report_text string")
    calls = ops.call_model(df, PromptSpec("Decide.", ("a",)), factory, partitions=1, side_by_side=4, max_retries=1)
    got = calls.collect()
    assert sorted(r["_ord"] for r in got) == list(range(8)) and {r["outcome"] for r in got} == {"answered"}


class Crash(Exception):
    pass


def sliced(spark, folder, rows=40, asked=None, **settings):
    """A run of one call per report in four parts."""
    def factory():
        def call(messages):
            if asked is not None:
                asked.add(1)
            return {"content": '{"a": 1}'}

        return call

    df = spark.createDataFrame([(i, f"v{i}", f"text {i}") for i in range(rows)], "_ord bigint, VolumeName string, report_text string")
    settings = {"output": str(folder), "slices": 4, "matching": {"order_by": "_ord"}, "partitions": 1, **settings}
    prompt = settings.pop("prompt", PromptSpec("Decide.", ("a",)))
    run = plans.generate_labels(df, prompt, factory, **settings)
    return sorted(r["VolumeName"] for r in run.labels.collect())


ALL = sorted(f"v{i}" for i in range(40))


@pytest.mark.parametrize("step, late", [(0, False), (0, True), (2, False), (2, True), (4, True)])
def test_a_crash_at_any_step_loses_and_doubles_nothing(spark, tmp_path, monkeypatch, step, late):
    """The run ends before or after the manifest or a mark is published, and is started again."""
    from tallymark.plans import label

    publish, made = label.publish, []

    def broken(*args):
        if len(made) == step and not late:
            raise Crash
        publish(*args)
        made.append(args)
        if len(made) > step:
            raise Crash

    monkeypatch.setattr(label, "publish", broken)
    with pytest.raises(Crash):
        sliced(spark, tmp_path / "out")
    monkeypatch.setattr(label, "publish", publish)
    asked = spark.sparkContext.accumulator(0)
    assert sliced(spark, tmp_path / "out", asked=asked) == ALL
    finished = max(0, step - 1 + late)
    assert 0 < asked.value < 40 if 0 < finished < 4 else asked.value == (0 if finished == 4 else 40)
    assert sorted(r["VolumeName"] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ALL


CHANGES = {
    "slices": {"slices": 3},
    "prompt": {"prompt": PromptSpec("Decide again.", ("a",))},
    "model": {"model": "other"},
    "reports": {"rows": 41},
    "options": {"text_col": "VolumeName"},
}


@pytest.mark.parametrize("changed", CHANGES)
def test_a_changed_call_is_refused_or_started_afresh(spark, tmp_path, monkeypatch, changed):
    from tallymark.plans import label

    publish, made = label.publish, []

    def broken(*args):
        publish(*args)
        made.append(args)
        if len(made) == 3:
            raise Crash

    monkeypatch.setattr(label, "publish", broken)
    with pytest.raises(Crash):
        sliced(spark, tmp_path / "out")
    monkeypatch.setattr(label, "publish", publish)
    with pytest.raises(ValueError, match=changed):
        sliced(spark, tmp_path / "out", **CHANGES[changed])
    expected = sorted(f"v{i}" for i in range(CHANGES[changed].get("rows", 40)))
    # How calls are made may change; what was refused has changed nothing.
    assert sliced(spark, tmp_path / "out", partitions=2, max_retries=1) == ALL
    assert sliced(spark, tmp_path / "out", on_change="restart", **CHANGES[changed]) == expected
    assert sorted(r["VolumeName"] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == expected


@pytest.mark.parametrize("step", [0, 2, 3])
def test_a_crash_while_starting_afresh(spark, tmp_path, monkeypatch, step):
    from tallymark.plans import label

    assert sliced(spark, tmp_path / "out") == ALL
    names, left = ("remove", "publish"), [step]

    def breaking(work):
        def broken(*args):
            if not left[0]:
                raise Crash
            left[0] -= 1
            return work(*args)

        return broken

    kept = {name: getattr(label, name) for name in names}
    for name in names:
        monkeypatch.setattr(label, name, breaking(kept[name]))
    with pytest.raises(Crash):
        sliced(spark, tmp_path / "out", slices=2, on_change="restart")
    for name in names:
        monkeypatch.setattr(label, name, kept[name])
    if step in (1, 2):  # rows without a manifest belong to no call
        with pytest.raises(ValueError, match="manifest"):
            sliced(spark, tmp_path / "out")
    assert sliced(spark, tmp_path / "out", slices=2, on_change="restart") == ALL


def test_slices_with_history_and_wrong_settings(spark, tmp_path):
    df = spark.createDataFrame([(i, f"v{i}", f"text {i}") for i in range(30)], "_ord bigint, VolumeName string, report_text string")
    first = str(tmp_path / "first")
    assert sliced(spark, first, rows=10) == sorted(f"v{i}" for i in range(10))
    history = spark.read.parquet(first).drop("slice")
    asked = spark.sparkContext.accumulator(0)
    for _ in range(2):
        assert sliced(spark, tmp_path / "second", asked=asked, history=history) == ALL
        assert asked.value == 30
    with pytest.raises(ValueError, match="output"):
        plans.generate_labels(df, PromptSpec("D", ("a",)), scripted({}), history=spark.read.parquet(first), output=first)
    with pytest.raises(ValueError):
        plans.generate_labels(df, PromptSpec("D", ("a",)), scripted({}), slices=2)
    with pytest.raises(ValueError):
        plans.generate_labels(df, PromptSpec("D", ("a",)), scripted({}), slices=2, output=first, on_change="maybe")


def test_a_task_holds_few_calls_at_once(spark, monkeypatch):
    """However many rows Spark sends at once, texts and answers become Python objects a few at a time."""
    import pyarrow as pa

    rows = spark.createDataFrame([("v", "text", 0)], "VolumeName string, report_text string, o bigint")
    made, told = [], []

    def factory():
        return lambda messages: made.append(1) or {"content": '{"L": 1}', "request_id": len(made)}

    monkeypatch.setattr(type(rows), "mapInArrow", lambda self, run, schema: told.append((run, self.schema)) or self)
    ops.call_model(rows, PromptSpec("Decide.", ("L",)), factory, order_by="o", keep_request=True)
    run, schema = told[0]
    n = 1000
    columns = [list(range(n)), ["v"] * n, ["h"] * n, [0] * n, [""] * n, ["ask", None] * (n // 2)]
    kinds = [pa.int64(), pa.string(), pa.string(), pa.int32(), pa.string(), pa.string()]
    batch = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], schema.names)
    parts = run(iter([batch]))
    first = next(parts)
    assert len(made) == first.num_rows / 2 <= 128
    rest = [first, *parts]
    assert [x for p in rest for x in p["_ord"].to_pylist()] == list(range(n)) and len(made) == n / 2
    assert first["outcome"].to_pylist()[:2] == ["answered", "skipped"] and first["user_message"].to_pylist()[:2] == ["ask", None]
    assert first["request_id"].to_pylist()[:2] == ["1", ""] and first["latency_seconds"][1].as_py() == 0.0
