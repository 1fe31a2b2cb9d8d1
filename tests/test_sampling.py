import pytest
from pyspark.sql import functions as F

from tallymark import operators as ops
from tallymark import plans


def labelled(spark, n, partitions=4):
    df = spark.range(n).select(
        "id", (F.col("id") % 10 == 0).cast("int").alias("a"), (F.col("id") % 3 == 0).cast("int").alias("b b")
    )
    return df.repartition(partitions)


def strata(df):
    return {(r["a"], r["b b"]): r["count"] for r in df.groupBy("a", "b b").count().collect()}


def largest_remainder(counts, n):
    total = sum(counts.values())
    n = min(n, total)
    share = {k: divmod(n * c, total) for k, c in counts.items()}
    quota = {k: s[0] for k, s in share.items()}
    order = sorted(counts, key=lambda k: (-share[k][1], -counts[k], k))
    for k in order[: n - sum(quota.values())]:
        quota[k] += 1
    return quota


@pytest.mark.parametrize("n", [1, 7, 100, 333, 999, 1000, 5000])
def test_allocation_is_exact(spark, n):
    df = labelled(spark, 1000)
    got = {(r["a"], r["b b"]): r["quota"] for r in ops.stratified_allocation(df, ["a", "b b"], n).collect()}
    assert got == largest_remainder(strata(df), n)
    assert sum(got.values()) == min(n, 1000)


def test_sample_has_the_quota_and_ignores_partitioning(spark, rows):
    one = ops.stratified_sample(labelled(spark, 1000, 2), ["a", "b b"], 100, "id")
    two = ops.stratified_sample(labelled(spark, 1000, 7), ["a", "b b"], 100, "id")
    assert rows(one) == rows(two)
    assert strata(one) == largest_remainder(strata(labelled(spark, 1000)), 100)
    other = ops.stratified_sample(labelled(spark, 1000), ["a", "b b"], 100, "id", seed=1)
    assert rows(other) != rows(one) and other.count() == 100


def test_sample_takes_the_lowest_hashes(spark):
    """Against a plain ranking of every stratum."""
    df = labelled(spark, 500)
    quota = largest_remainder(strata(df), 60)
    ranked = df.withColumn("h", F.md5(F.concat(F.col("id").cast("string"), F.lit(":42")))).collect()
    expected = set()
    for key, k in quota.items():
        group = sorted((r for r in ranked if (r["a"], r["b b"]) == key), key=lambda r: r["h"])
        expected |= {r["id"] for r in group[:k]}
    assert {r["id"] for r in ops.stratified_sample(df, ["a", "b b"], 60, "id").collect()} == expected


def test_sample_of_more_than_all_is_all(spark, rows):
    df = labelled(spark, 30)
    assert rows(ops.stratified_sample(df, ["a", "b b"], 100, "id")) == rows(df)


def test_sample_checks_arguments(spark):
    df = labelled(spark, 10)
    with pytest.raises(ValueError):
        ops.stratified_sample(df, ["a"], 0, "id")
    with pytest.raises(ValueError, match="missing"):
        ops.stratified_sample(df, ["missing"], 5, "id")


def test_top_up_adds_other_rows(spark):
    df = labelled(spark, 50)
    part = df.where("id < 5")
    full = ops.top_up(df, part, 12, "id")
    ids = [r["id"] for r in full.collect()]
    assert len(ids) == len(set(ids)) == 12 and {0, 1, 2, 3, 4} <= set(ids)
    assert ops.top_up(df, part, 5, "id").count() == 5
    assert ops.top_up(df, part, 500, "id").count() == 50


def test_tuning_set_reports_prevalence(spark):
    result = plans.make_tuning_set(labelled(spark, 1000), ["a", "b b"], n=100, key="id")
    table = {r["label"]: r for r in result.label_prevalence.collect()}
    assert table["a"]["input_percent"] == 10.0
    assert abs(table["b b"]["output_percent"] - table["b b"]["input_percent"]) <= 1.0
    assert result.tuning_set.count() == 100


def test_unique_scans_prefers_long_then_early(spark, rows):
    data = [
        ("s_1.nii.gz", "short", None, 2),
        ("s_2.nii.gz", "longer text", " ", 1),
        ("s_3.nii.gz", "longer", "xxx", 0),
        ("t_1.nii.gz", None, "", 3),
        ("u.nii", "x", "y", 4),
        (None, "z", None, 5),
    ]
    df = spark.createDataFrame(data, "VolumeName string, f string, i string, k int").repartition(3)
    got = ops.unique_scans(df, ["f", "i"], ["k", "nothing"], order_by="k")
    assert got.columns == ["VolumeName", "report_text", "k"]
    assert rows(got) == [("", "z", 5), ("s", "longer\n\nxxx", 0), ("t", "", 3), ("u.nii", "x\n\ny", 4)]
    with pytest.raises(ValueError):
        ops.unique_scans(df, ["missing"])
    with pytest.raises(ValueError):
        ops.unique_scans(df, [])


def test_example_blocks(spark):
    data = [("v0", "  one\r\n two\x0bthree \n", "1", 0), ("v1", None, "x", 1), ("v2", "last", None, 2)]
    df = spark.createDataFrame(data, "VolumeName string, report_text string, `Lung ü` string, _ord bigint")
    got = ops.format_examples(df, ["Lung ü", "absent"], positions=[2, 0, 9, 1]).orderBy("rank").collect()
    assert [(r["rank"], r["VolumeName"]) for r in got] == [(0, "v2"), (1, "v0"), (3, "v1")]
    assert got[1]["block"] == (
        "  - report: |\n      one\n       two\n      three\n"
        '    output: {"Lung \\u00fc": 1, "absent": 0}\n'
    )
    assert got[2]["block"] == '  - report: |\n    output: {"Lung \\u00fc": 0, "absent": 0}\n'
    assert ops.format_examples(df, ["absent"], n=2).count() == 2
    assert ops.format_examples(df, ["absent"], n=20).count() == 3


def test_samples_equal_a_full_sort(spark, rows):
    df = labelled(spark, 400)
    ranked = df.withColumn("h", F.md5(F.concat(F.col("id").cast("string"), F.lit(":42")))).orderBy("h").collect()
    for n in (1, 150, 399):
        assert {r["id"] for r in ops.sample_rows(df, n, "id").collect()} == {r["id"] for r in ranked[:n]}
    assert ops.sample_rows(df, 1000, "id").count() == 400


@pytest.mark.parametrize("n", [1, 40, 150, 299, 300, 500])
def test_null_and_repeated_keys_are_drawn_like_others(spark, n):
    """A third of the rows has no key, a third one and the same, some rows are alike in all columns."""
    key = F.when(F.col("id") % 3 == 1, F.lit(7)).when(F.col("id") % 3 == 2, F.col("id"))
    df = spark.range(300).select(key.alias("k"), F.floor(F.col("id") / 2).alias("v"), (F.col("id") % 2).cast("int").alias("a"))
    drawn = ops.sample_rows(df, n, "k")
    assert drawn.count() == min(n, 300) and drawn.exceptAll(df).count() == 0
    strata_of = ops.stratified_sample(df, ["a"], n, "k")
    assert strata_of.count() == min(n, 300) and strata_of.exceptAll(df).count() == 0
    if n == 150:
        counts = {r["kind"]: r["count"] for r in drawn.groupBy(F.coalesce(F.col("k") == 7, F.lit(None)).alias("kind")).count().collect()}
        assert counts[None] > 20 and counts[False] > 20
    full = ops.top_up(df, df.where("v < 10"), n, "k")
    assert full.count() >= min(n, 20) and full.exceptAll(df).count() == 0


def test_sketch_and_buckets_draw_the_same_rows(spark, monkeypatch):
    """Keys that repeat and null keys, drawn both ways."""
    from tallymark.operators import sampling

    rows = [(i % 37 if i % 5 else None, f"row {i % 200}") for i in range(600)]
    df = spark.createDataFrame(rows, "k int, text string").coalesce(3)
    monkeypatch.setattr(sampling, "MERGED", 2)
    sketched = sorted(map(repr, ops.sample_rows(df, 50, "k").collect()))
    monkeypatch.setattr(sampling, "SKETCH", 0)
    assert sorted(map(repr, ops.sample_rows(df, 50, "k").collect())) == sketched and len(sketched) == 50
