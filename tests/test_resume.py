import hashlib

import pytest

from tallymark import PromptSpec, plans, streaming
from tallymark import operators as ops

PROMPT = PromptSpec("s", ("L",))


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def reports(spark, *rows):
    data = [(v, t, i) for i, (v, t) in enumerate(rows)]
    return spark.createDataFrame(data, "VolumeName string, report_text string, _ord bigint").repartition(3)


def history(spark, *rows):
    data = [(v, sha(t) if t else "", s, i, i) for i, (v, t, s) in enumerate(rows)]
    schema = "VolumeName string, report_hash string, status string, L int, _ord bigint"
    return spark.createDataFrame(data, schema).repartition(3)


def reused(found):
    return sorted((r["VolumeName"], r["reuse"], r["L"]) for r in found.reused.collect())


def todo(found):
    return sorted(r["VolumeName"] for r in found.todo.collect())


def test_id_first_then_hash(spark):
    found = ops.resume_match(
        reports(spark, ("a", "one"), ("b", "two"), ("c", "three"), ("d", "four"), ("e", None)),
        history(spark, ("a", "old text", "success"), ("x", "two", "error"), ("y", "four", "success"), ("z", "four", "success"), ("q", "gone", "success")),
    )
    assert reused(found) == [("a", "id", 0), ("b", "hash", 1)]
    assert todo(found) == ["c", "d", "e"]
    stats = found.stats.first().asDict()
    assert stats == {
        "input_rows": 5,
        "matched_by_id": 1,
        "matched_by_hash": 1,
        "hash_collisions": 1,
        "unmatched_ids": 3,
        "unmatched_hash_rows": 3,
        "to_label": 3,
    }


def test_last_row_of_an_id_serves_the_first_report(spark):
    found = ops.resume_match(
        reports(spark, ("a", "t1"), ("a", "t2")),
        history(spark, ("a", "h0", "success"), ("a", "h1", "success"), ("a", "h2", "success")),
    )
    assert reused(found) == [("a", "id", 2)]
    assert [r["report_text"] for r in found.todo.collect()] == ["t2"]


def test_older_row_of_an_id_still_serves_by_hash(spark):
    found = ops.resume_match(
        reports(spark, ("a", "new"), ("b", "text"), ("c", "text")),
        history(spark, ("a", "text", "success"), ("a", "other", "success")),
    )
    assert reused(found) == [("a", "id", 1), ("b", "hash", 0)]
    assert todo(found) == ["c"]


def test_consumed_row_leaves_its_hash_bucket(spark):
    """Two rows share a text; once one is used by ID the other is unique."""
    found = ops.resume_match(
        reports(spark, ("a", "same"), ("n", "same")),
        history(spark, ("a", "same", "success"), ("b", "same", "success")),
    )
    assert reused(found) == [("a", "id", 0), ("n", "hash", 1)]


def test_options(spark):
    new = reports(spark, ("a", "edited"), ("b", "same"))
    old = history(spark, ("a", "original", "success"), ("b", "same", "error"))
    assert todo(ops.resume_match(new, old)) == []
    assert todo(ops.resume_match(new, old, require_same_hash=True)) == ["a"]
    assert todo(ops.resume_match(new, old, retry_status=("error",))) == ["b"]


def test_history_without_hash_or_status(spark):
    old = spark.createDataFrame([("a", 1, 0), ("", 1, 1), (None, 1, 2)], "volumename string, L int, _ord bigint")
    found = ops.resume_match(reports(spark, ("a", "x"), ("", "y"), (None, "z")), old)
    assert reused(found) == [("a", "id", 1)]
    assert found.todo.count() == 2


def test_one_text_in_many_rows(spark):
    """A third of all reports share a text; exactly one of them is served by it."""
    rows = [(f"v{i}", "boilerplate" if i % 3 == 0 else f"text {i}") for i in range(300)]
    found = ops.resume_match(reports(spark, *rows), history(spark, ("old", "boilerplate", "success")))
    assert reused(found) == [("v0", "hash", 0)]
    assert found.todo.count() == 299


def counting_model(folder):
    """Model that leaves one file per call."""

    def factory():
        import os
        import uuid

        def call(messages):
            open(os.path.join(folder, uuid.uuid4().hex), "w").close()
            return {"content": '{"L": 1}', "prompt_tokens": 1, "completion_tokens": 1}

        return call

    return factory


@pytest.fixture
def calls(tmp_path):
    folder = tmp_path / "calls"
    folder.mkdir()
    return folder


def test_batch_labels_only_the_rest(spark, calls):
    run = plans.generate_labels(
        reports(spark, ("a", "one"), ("b", "two"), ("c", "three")),
        PROMPT,
        counting_model(str(calls)),
        history=history(spark, ("a", "one", "success"), ("old", "two", "error"), ("gone", "x", "success")),
    )
    got = {r["VolumeName"]: r["L"] for r in run.labels.collect()}
    assert got == {"a": 0, "b": 1, "c": 1}
    assert len(list(calls.iterdir())) == 1
    totals = run.run_summary.first()
    assert (totals["total_reports"], totals["resumed_reports"], totals["error"]) == (3, 2, 1)


def test_output_of_a_run_is_the_history_of_the_next(spark, tmp_path, calls):
    first, second = str(tmp_path / "first"), str(tmp_path / "second")
    rows = [("a", "one"), ("b", "two")]
    model = counting_model(str(calls))
    plans.generate_labels(reports(spark, *rows), PROMPT, model, output=first)
    assert spark.read.parquet(first).columns == ops.run_columns(["L"])
    again = plans.generate_labels(
        reports(spark, *rows, ("c", "three")), PROMPT, model, history=spark.read.parquet(first), output=second
    )
    assert again.run_summary.first()["resumed_reports"] == 2
    assert len(list(calls.iterdir())) == 3
    marked = spark.read.parquet(second).selectExpr("*", "'id' AS reuse", "0L AS _prior_ord")
    assert len(reused(ops.resume_match(reports(spark, *rows), marked))) == 2


SCHEMA = "VolumeName string, report_text string, o bigint"


def arrive(spark, folder, name, *rows):
    spark.createDataFrame(list(rows), SCHEMA).coalesce(1).write.parquet(f"{folder}/in/{name}")


def run_stream(spark, folder, calls, **options):
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in/*")
    query = streaming.incremental_label(
        stream, f"{folder}/out", f"{folder}/checkpoint", PROMPT, counting_model(str(calls)), **options
    )
    query.awaitTermination()
    return sorted(r["VolumeName"] for r in spark.read.parquet(f"{folder}/out").collect())


def test_stream_labels_each_report_once(spark, tmp_path, calls):
    arrive(spark, tmp_path, "p1", ("v1", "one", 0), ("v2", "two", 1))
    assert run_stream(spark, tmp_path, calls) == ["v1", "v2"]
    arrive(spark, tmp_path, "p2", ("v2", "two", 2), ("v3", "three", 3), ("v4", "one", 4))
    assert run_stream(spark, tmp_path, calls) == ["v1", "v2", "v3", "v4"]
    assert len(list(calls.iterdir())) == 3
    assert run_stream(spark, tmp_path, calls) == ["v1", "v2", "v3", "v4"]
    assert len(list(calls.iterdir())) == 3


def test_replayed_batch_is_not_labelled_again(spark, tmp_path, calls):
    """The commit of a batch is lost after its rows were written."""
    arrive(spark, tmp_path, "p1", ("v1", "one", 0), ("v1", "other", 1))
    assert run_stream(spark, tmp_path, calls, order_by="o") == ["v1", "v1"]
    for file in (tmp_path / "checkpoint" / "commits").iterdir():
        file.unlink()
    assert run_stream(spark, tmp_path, calls, order_by="o") == ["v1", "v1"]
    assert len(list(calls.iterdir())) == 2


def test_unfinished_batch_is_written_again(spark, tmp_path, calls):
    """Rows were written but the batch was neither listed nor committed."""
    import shutil

    arrive(spark, tmp_path, "p1", ("v1", "one", 0), ("v2", "two", 1))
    run_stream(spark, tmp_path, calls, order_by="o")
    for file in (tmp_path / "checkpoint" / "commits").iterdir():
        file.unlink()
    shutil.rmtree(tmp_path / "out" / "_batches")
    assert run_stream(spark, tmp_path, calls, order_by="o") == ["v1", "v2"]
    assert len(list(calls.iterdir())) == 4


def run_state(spark, folder, calls, prompt=PROMPT, model=None, files=1):
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files).parquet(f"{folder}/in/*")
    streaming.incremental_label_state(
        stream, f"{folder}/out", f"{folder}/checkpoint", prompt, model or counting_model(str(calls)), order_by="o",
        wait_seconds=(0.0, 0.0),
    ).awaitTermination()
    rows = spark.read.parquet(f"{folder}/out").collect()
    return sorted((r["VolumeName"], r["reuse"], r["status"]) for r in rows)


def test_state_labels_each_id_and_text_once(spark, tmp_path, calls):
    arrive(spark, tmp_path, "p1", ("v1", "one", 0), ("v2", "two", 1), ("v1", "other", 2), ("v5", " ", 3), ("", "one", 4), (None, "five", 5))
    first = [("", "hash", "success"), ("", "none", "success"), ("v1", "none", "success"), ("v2", "none", "success"), ("v5", "none", "skipped")]
    assert run_state(spark, tmp_path, calls) == first
    assert len(list(calls.iterdir())) == 3
    arrive(spark, tmp_path, "p2", ("v2", "new", 6), ("v3", "three", 7), ("v4", "one", 8), ("v5", "late", 9))
    second = sorted([*first, ("v3", "none", "success"), ("v4", "hash", "success")])
    assert run_state(spark, tmp_path, calls) == second
    assert len(list(calls.iterdir())) == 4
    # Nothing new, and the output is not what is asked: the state is.
    assert run_state(spark, tmp_path, calls) == second
    assert len(list(calls.iterdir())) == 4


def test_state_does_not_read_the_output(spark, tmp_path, calls):
    import shutil

    arrive(spark, tmp_path, "p1", ("v1", "one", 0))
    run_state(spark, tmp_path, calls)
    shutil.rmtree(tmp_path / "out")
    arrive(spark, tmp_path, "p2", ("v1", "again", 1), ("v2", "one", 2))
    assert run_state(spark, tmp_path, calls) == [("v2", "hash", "success")]
    assert len(list(calls.iterdir())) == 1


def test_state_survives_a_replayed_batch(spark, tmp_path, calls):
    """Rows of the second batch were written, its commit is lost: it starts again from the state before it."""
    arrive(spark, tmp_path, "p1", ("v1", "one", 0))
    run_state(spark, tmp_path, calls)
    arrive(spark, tmp_path, "p2", ("v2", "two", 1), ("v3", "one", 2), ("v1", "two", 3))
    expected = [("v1", "none", "success"), ("v2", "none", "success"), ("v3", "hash", "success")]
    assert run_state(spark, tmp_path, calls) == expected
    commits = sorted((tmp_path / "checkpoint" / "commits").glob("[0-9]*"), key=lambda p: int(p.name))
    commits[-1].unlink()
    (commits[-1].parent / f".{commits[-1].name}.crc").unlink()
    assert run_state(spark, tmp_path, calls) == expected
    arrive(spark, tmp_path, "p3", ("v4", "two", 4))
    assert run_state(spark, tmp_path, calls) == [*expected, ("v4", "hash", "success")]


def test_state_forgets_failed_calls_and_asks_per_label(spark, tmp_path, calls):
    single = PromptSpec("Decide.", ("a", "b"), "single")
    broken = tmp_path / "broken"
    broken.touch()

    def factory():
        def call(messages):
            import pathlib

            user = messages[-1]["content"]
            if pathlib.Path(broken).exists() and "- b" in user:
                raise ValueError("down")
            return {"content": '{"a": 1, "b": 1}', "prompt_tokens": 3}

        return call

    arrive(spark, tmp_path, "p1", ("v1", "one", 0), ("v2", "one", 1))
    assert run_state(spark, tmp_path, calls, single, factory) == [("v1", "none", "error"), ("v2", "none", "error")]
    broken.unlink()
    arrive(spark, tmp_path, "p2", ("v3", "one", 2), ("v4", "one", 3))
    assert run_state(spark, tmp_path, calls, single, factory)[2:] == [("v3", "none", "success"), ("v4", "hash", "success")]
    rows = {r["VolumeName"]: r for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert (rows["v4"]["a"], rows["v4"]["b"], rows["v4"]["prompt_tokens"]) == (1, 1, 6) and rows["v1"]["b"] == 0


def test_state_makes_no_frame_per_text(spark, tmp_path, calls, monkeypatch):
    """Most texts come once, so what is made per text counts; every row comes out, once."""
    from pyspark.sql import GroupedData

    def refuse(*args, **kwargs):
        raise AssertionError("a pandas frame for every ID and text")

    for name in ("transformWithStateInPandas", "applyInPandasWithState"):
        monkeypatch.setattr(GroupedData, name, refuse)
    arrive(spark, tmp_path, "p1", *[(f"v{i % 250}", f"text {i % 120}", i) for i in range(300)])
    rows = run_state(spark, tmp_path, calls)
    assert len(rows) == 250 and sum(r[1] == "none" for r in rows) == 120 == len(list(calls.iterdir()))
    told = spark.read.parquet(f"{tmp_path}/out").collect()
    assert all(r["latency_seconds"] >= 0 and r["started_at_utc"] and r["retry_count"] == 1 for r in told)
