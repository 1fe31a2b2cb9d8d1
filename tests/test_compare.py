import math

import pytest
from pyspark.sql import functions as F

from tallymark import IdRule, plans
from tallymark import operators as ops


@pytest.fixture
def runs(spark):
    ids = ["scan1.nii.gz", "scan2.nii.gz", "scan3.nii.gz"]
    a = [(i, v, w, n) for n, (i, v, w) in enumerate(zip(ids, [1, 0, 1], [0, 1, 0]))]
    b = [(i, v, w, n) for n, (i, v, w) in enumerate(zip(["scan1", "scan2.nii", "scan3_2"], [1, 1, 0], [0, 1, 1]))]
    schema = "VolumeName string, LabelA int, LabelB int, _ord int"
    return spark.createDataFrame(a, schema), spark.createDataFrame(b, schema)


def by_label(df):
    return {r["label"]: r.asDict() for r in df.collect()}


def test_column_lookup(spark):
    df = spark.createDataFrame([(1, 2)], "VolumeName int, LabelA int")
    assert ops.resolve_column(df, "volumename") == "VolumeName"
    with pytest.raises(KeyError):
        ops.resolve_column(df, "other")
    assert ops.canonical_id(spark.createDataFrame([("a",)], "VOLUMENAME string")).columns == ["VolumeName"]
    with pytest.raises(ValueError, match="report_text"):
        ops.require_columns(df, ["report_text"])


def test_shared_labels(spark):
    a = spark.createDataFrame([], "VolumeName string, Zeta int, alpha int, status string, only_a int, _ord int")
    b = spark.createDataFrame([], "volumename string, ALPHA int, zeta int, status string, _ord int")
    assert ops.shared_labels([a, b]) == ["alpha", "Zeta"]
    assert ops.pair_labels(a, b) == ["Zeta", "alpha"]
    assert ops.shared_labels([a, b], labels=[" zeta ", ""]) == ["zeta"]
    with pytest.raises(ValueError):
        ops.shared_labels([a, b], exclude=["VolumeName", "alpha", "zeta"])


def test_confusion_and_metrics(runs):
    left, right = runs
    aligned = ops.align_pair(left, right, ["LabelA", "LabelB"])
    counts = by_label(ops.confusion_counts(aligned, ["LabelA", "LabelB"]))
    assert [counts["LabelA"][c] for c in ("tp", "fp", "fn", "tn")] == [1, 1, 1, 0]
    metrics = by_label(ops.compare_metrics(aligned, ["LabelA", "LabelB"]))
    assert metrics["LabelA"]["precision"] == 0.5
    assert metrics["LabelB"]["accuracy"] == 0.6667
    assert metrics["MACRO_AVERAGE"]["tp"] == 2
    assert metrics["MICRO_AVERAGE"]["precision"] == 0.5


def frame(spark, truth, pred):
    pairs = [(str(i), t, p) for i, (t, p) in enumerate(zip(truth, pred))]
    kind = "string" if any(isinstance(v, str) for v in truth + pred) else "int"
    return spark.createDataFrame(pairs, f"VolumeName string, true_L {kind}, pred_L {kind}")


@pytest.mark.parametrize(
    "truth, pred, scores",
    [
        ([0, 0, 0], [0, 0, 0], (1.0, 1.0, 1.0)),
        ([0, 0, 0], [0, 1, 0], (0.0, 0.0, 0.0)),
        (["1", "0", None], ["1", None, "1"], (0.5, 1.0, 0.6667)),
        ([1, 1, 0], [0, 0, 0], (0.0, 0.0, 0.0)),
    ],
)
def test_zero_support_and_coercion(spark, truth, pred, scores):
    row = by_label(ops.compare_metrics(frame(spark, truth, pred), ["L"]))["L"]
    assert (row["precision"], row["recall"], row["f1"]) == scores


def test_micro_has_no_zero_support_rule(spark):
    rows = by_label(ops.compare_metrics(frame(spark, [0, 0], [0, 0]), ["L"]))
    assert rows["MACRO_AVERAGE"]["f1"] == 1.0
    assert rows["MICRO_AVERAGE"]["f1"] == 0.0
    assert rows["MICRO_AVERAGE"]["accuracy"] == 1.0


def test_other_integers_enter_no_cell(spark):
    row = by_label(ops.compare_metrics(frame(spark, [2, 1, 0], [1, 1, 0]), ["L"]))["L"]
    assert [row[c] for c in ("tp", "fp", "fn", "tn")] == [1, 0, 0, 1]


def test_discrepancies(spark, rows):
    df = frame(spark, [1, 0, 1], [1, 1, 0])
    assert rows(ops.discrepancies(df, ["L"])) == [("1", "L", 1, 0), ("2", "L", 0, 1)]


def test_many_labels_give_the_same_as_few(spark):
    """Beyond the pattern limit rows are not pre-counted; results must not change."""
    labels = [f"L {i}.x" for i in range(9)]
    data = [(f"v{r}", *[(r >> i) & 1 for i in range(9)], r) for r in range(300)]
    schema = "VolumeName string, " + ", ".join(f"`{x}` int" for x in labels) + ", _ord int"
    left = spark.createDataFrame(data, schema)
    right = spark.createDataFrame([(v, *reversed(x), o) for v, *x, o in data], schema)
    wide = by_label(ops.compare_metrics(ops.align_pair(left, right, labels), labels))
    for label in labels:
        alone = by_label(ops.compare_metrics(ops.align_pair(left, right, [label]), [label]))
        assert {k: v for k, v in alone[label].items() if k != "label_pos"} == {
            k: v for k, v in wide[label].items() if k != "label_pos"
        }
    table = ops.pair_table(left, right, labels)
    few, many = (ops.compare_summary(table, x).first() for x in (labels[:2], labels))
    assert few["matched_reports"] == many["matched_reports"] == 300


def test_first_row_of_an_id_is_kept(spark, rows):
    data = [("a_1", 1, "x", 5), ("a_2", 0, "y", 3), ("b", None, None, 1), ("b", 1, "z", 2)]
    df = spark.createDataFrame(data, "VolumeName string, L int, t string, o int").repartition(3)
    named = ops.normalize_ids(df)
    assert rows(ops.dedupe_first(named, order_by="o")) == [("a", 0, "y", 3), ("b", None, None, 1)]
    assert rows(ops.keep_last(named.drop("t"), order_by="o")) == [("a", 1, 5), ("b", 1, 2)]


def test_hot_id_collapses_to_its_first_row(spark):
    """A third of all rows share one ID on either side."""
    df = spark.range(3000).selectExpr(
        "if(id % 3 = 0, 'hot_1.nii', concat('v_', id, '_1')) AS VolumeName",
        "cast(id >= 6 AS int) AS L",
        "2999 - id AS _ord",
    )
    aligned = ops.align_pair(df, df.repartition(7), ["L"])
    assert aligned.count() == 2001
    assert aligned.where("VolumeName = 'hot'").first()["true_L"] == 1


def test_null_ids_match_each_other(spark):
    df = spark.createDataFrame([(None, 1, 0), ("nan", 0, 1)], "VolumeName string, L int, _ord int")
    assert ops.align_pair(df, df, ["L"]).count() == 1


@pytest.fixture
def repeated(spark):
    schema = "VolumeName string, L int, _ord int"
    left = spark.createDataFrame([("a_1", 1, 0), ("a_1", 0, 1), ("b_1", 1, 2), ("c_1", 1, 3)], schema)
    right = spark.createDataFrame([("a_1", 1, 0), ("a_1", 1, 1), ("a_1", 0, 2), ("b_1", 0, 3), ("d_1", 1, 4)], schema)
    return left, right


def test_kept_suffixes_pair_many_to_many(repeated, rows):
    left, right = repeated
    rule = IdRule(keep_reconstruction_suffix=True)
    result = plans.compare_runs(left, right, ["L"], rule=rule)
    plain = left.select("VolumeName", F.col("L").alias("true_L")).join(
        right.select("VolumeName", F.col("L").alias("pred_L")), "VolumeName"
    )
    expected = by_label(ops.compare_metrics(plain, ["L"]))
    assert by_label(result.evaluation_metrics) == expected
    single = ops.discrepancies(plain, ["L"]).groupBy("VolumeName", "Label", "Predicted", "Actual").count()
    counted = result.discrepancies.groupBy("VolumeName", "Label", "Predicted", "Actual").agg(F.sum("Count"))
    assert rows(counted) == rows(single)
    summary = result.run_summary.first()
    assert (summary["matched_reports"], summary["left_only"], summary["right_only"]) == (7, 1, 1)
    assert summary["exact_match_count"] == 3


def test_summary_counts_raw_equality(spark):
    left = spark.createDataFrame([("a", "1", 0), ("b", None, 1), ("c", "x", 2), ("e", "0", 3)], "id string, L string, _ord int")
    right = spark.createDataFrame([("a", "1.0", 0), ("b", None, 1), ("c", "0", 2), ("d", "1", 3)], "Id string, l string, _ord int")
    table = ops.pair_table(left, right, ["L"], left_id="ID", right_id="id")
    row = ops.compare_summary(table, ["L"], "expert", "model").first()
    assert row["exact_match_count"] == 1
    assert row["total_correct_labels"] == 3
    assert (row["expert_only"], row["model_only"], row["label_accuracy"]) == (1, 1, 1.0)


def test_agreement_scores(runs, rows):
    left, right = runs
    votes = ops.run_votes(ops.align_runs({"a": left, "b": right}), ["a", "b"], ["LabelA", "LabelB"])
    table = by_label(ops.pairwise_agreement(votes, ["a", "b"]))
    row = table["LabelA"]
    assert (row["pair"], row["tp"], row["fp"], row["fn"], row["tn"], row["n"]) == ("a vs b", 1, 1, 1, 0, 3)
    assert row["agreement"] == 0.3333
    assert row["cohen_kappa"] == -0.5
    assert row["mcc"] == -0.5
    assert rows(ops.all_sets_agreement(votes, ["a", "b"]).drop("label_pos")) == [
        ("LabelA", 0.3333, 1, 0, 3),
        ("LabelB", 0.6667, 1, 1, 3),
    ]


def test_agreement_is_symmetric_and_certain_runs_agree(spark):
    data = [(f"v{i}", 1, i % 2, i) for i in range(10)]
    a = spark.createDataFrame(data, "VolumeName string, L int, M int, _ord int")
    votes = ops.run_votes(ops.align_runs({"a": a, "b": a}), ["a", "b"], ["L", "M"])
    table = by_label(ops.pairwise_agreement(votes, ["a", "b"]))
    assert table["L"]["cohen_kappa"] == 1.0 and table["L"]["mcc"] == 0.0
    assert table["M"]["cohen_kappa"] == 1.0 and table["M"]["mcc"] == 1.0


def test_large_counts_do_not_overflow(spark):
    df = spark.createDataFrame([(3_000_000_000, 10, 20, 4_000_000_000)], "tp long, fp long, fn long, tn long")
    from tallymark.operators.agreement import agreement_columns

    values = agreement_columns(*[F.col(c) for c in ("tp", "fp", "fn", "tn")])
    row = df.select(*[v.alias(k) for k, v in values.items()]).first()
    assert row["n"] == 7_000_000_030 and math.isclose(row["mcc"], 1.0)


def test_thresholds():
    assert [ops.vote_threshold(s, 3) for s in ops.STRATEGIES] == [1, 2, 3]
    assert ops.vote_threshold("majority", 4) == 3
    with pytest.raises(ValueError):
        ops.vote_threshold("most", 3)


def test_consensus(spark, rows):
    data = [("s1", 1, 0, 1, 0), ("s2", 0, 1, 1, 1), ("s3", 1, 0, 0, 1)]
    names = "VolumeName string, run1__A int, run1__B int, run2__A int, run2__B int"
    aligned = spark.createDataFrame(data, names)
    any_ = ops.consensus(aligned, ["run1", "run2"], ["A", "B"], "any_positive")
    assert rows(any_) == [("s1", 1, 0), ("s2", 1, 1), ("s3", 1, 1)]
    all_ = ops.consensus(aligned, ["run1", "run2"], ["A", "B"], "unanimity")
    assert rows(all_) == [("s1", 1, 0), ("s2", 0, 1), ("s3", 0, 0)]


def test_runs_need_company(runs):
    with pytest.raises(ValueError):
        ops.align_runs({"a": runs[0]})


def test_workflows_save_their_tables(spark, runs, tmp_path, rows):
    left, right = runs
    named = {"a": left, "b": right, "c": left}
    agreement = plans.agree_runs(named)
    ensemble = plans.ensemble_runs(named, output=str(tmp_path / "ensemble"))
    agreement.save(str(tmp_path / "agreement"), "csv")
    ensemble.save(str(tmp_path / "ensemble"))
    summary = spark.read.json(str(tmp_path / "agreement" / "run_summary")).first()
    assert summary["total_reports_matched"] == 3 and summary["num_pairs"] == 3
    majority = spark.read.parquet(str(tmp_path / "ensemble" / "consensus_majority"))
    assert rows(majority) == [("scan1", 1, 0), ("scan2", 0, 1), ("scan3", 1, 0)]
    counted = {r["strategy"]: r["num_positive_labels"] for r in ensemble.run_summary.collect()}
    assert counted["any_positive"] >= counted["majority"] >= counted["unanimity"]


def test_discrepancy_triage(spark):
    data = [("A", "1", "0"), ("A", "1", "0"), ("B", "0", "1"), (None, "x", "1"), ("B", "3", "1")]
    df = spark.createDataFrame(data, "Label string, Predicted string, Actual string")
    summary = ops.discrepancy_summary(df)
    got = [tuple(r) for r in summary.collect()]
    assert got[0] == ("A", "false_positive", 2)
    assert set(got[1:]) == {("B", "false_negative", 1), ("B", "other", 1), (None, "false_negative", 1)}
    assert got[-1][0] is None
    assert [tuple(r) for r in ops.discrepancy_totals(summary).collect()] == [("A", 2), ("B", 2), (None, 1)]
    assert ops.top_rows(summary, 1).count() == 1
    assert ops.top_rows(summary, 0).count() == ops.top_rows(summary, None).count() == 4
    with pytest.raises(ValueError):
        ops.discrepancy_summary(df.drop("Actual"))


def test_mean_and_population_std(spark):
    row = {"label": "x", "precision": 0.4, "recall": 0.5, "f1": 0.5, "accuracy": 1.0, "tp": 1, "fp": 2, "fn": 3, "tn": 4}
    other = {**row, "precision": 0.3, "tp": 3}
    metrics = spark.createDataFrame([row, other])
    got = ops.metrics_mean_std(metrics).first()
    assert (got["precision_mean"], got["precision_std"], got["tp_mean"], got["tp_std"]) == (0.35, 0.05, 2.0, 1.0)
    with pytest.raises(ValueError, match="accuracy"):
        ops.metrics_mean_std(metrics.drop("accuracy"))
