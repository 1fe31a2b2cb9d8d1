"""As-of joins and bit-sliced votes against plain versions."""

import random

import pytest
from pyspark.sql import functions as F

from tallymark import operators as ops

CALLS, STATES = "k string, at bigint, n int", "k string, since bigint, label string, weight int"


def plain_asof(calls, states):
    out = []
    for k, at, n in calls:
        held = [(s, (label, weight)) for key, s, label, weight in states if None not in (k, at, key, s) and key == k and s <= at]
        last = max((s for s, _ in held), default=None)
        best = max(((v[0] is not None, v[0] or "", v[1]) for s, v in held if s == last), default=(False, None, None))
        out.append((k, at, n, best[1] if best[0] else None, best[2]))
    return sorted(out, key=repr)


@pytest.mark.parametrize("ranges", [1, 4, 64])
def test_asof_join(spark, ranges):
    """A key with two thirds of the rows, equal times on both sides, keys without states, nulls."""
    draw = random.Random(ranges)
    keys = ["hot"] * 6 + ["a", "b", None]
    calls = [(draw.choice(keys), draw.choice([None, *range(60)]), i) for i in range(300)] + [("lonely", 5, 1000)] * 2
    states = [(draw.choice(keys), draw.choice([None, *range(0, 60, 3)]), f"l{i % 9}", i) for i in range(120)] + [("never asked", 1, "x", 1)]
    found = ops.asof_join(
        spark.createDataFrame(calls, CALLS).repartition(3), spark.createDataFrame(states, STATES), "k", "at", ["label", "weight"], state_at="since", ranges=ranges
    )
    assert found.columns == ["k", "at", "n", "label", "weight"]
    assert sorted(map(tuple, found.collect()), key=repr) == plain_asof(calls, states)


def test_asof_join_without_rows_and_with_wrong_columns(spark):
    calls, states = spark.createDataFrame([("a", 1, 1)], CALLS), spark.createDataFrame([], STATES)
    assert [tuple(r) for r in ops.asof_join(calls, states, "k", "at", ["label"], state_at="since").collect()] == [("a", 1, 1, None)]
    assert ops.asof_join(calls.limit(0), states, "k", "at", ["label"], state_at="since").count() == 0
    with pytest.raises(ValueError, match="already"):
        ops.asof_join(calls, calls, "k", "at", ["n"])
    with pytest.raises(ValueError, match="times"):
        ops.asof_join(calls, calls.withColumnRenamed("n", "m"), "k", "k", ["m"])


def test_bit_votes_count_like_patterns(spark):
    """70 rows in three partitions, so words are partly filled; votes of 2 enter no cell."""
    rows = [(i, *[(i * (j + 2)) % 7 % 3 for j in range(8)]) for i in range(70)]
    names = [f"r{j}__{label}" for j in range(4) for label in ("a", "b")]
    aligned = spark.createDataFrame(rows, ["id", *names]).repartition(3)
    runs, labels = ["r0", "r1", "r2", "r3"], ["a", "b"]
    words = ops.bit_votes(aligned, runs, labels)
    expected = ops.pairwise_agreement(ops.run_votes(aligned, runs, labels), runs)
    found = ops.pairwise_agreement_bits(words, runs)
    assert sorted(map(tuple, found.select(expected.columns).collect())) == sorted(map(tuple, expected.collect()))
    alike = aligned.select("id", *[F.when(F.col("id") % 3 > 0, F.col("id") % 2).otherwise(F.col(n) % 2).alias(n) for n in names])
    expected = ops.all_sets_agreement(ops.run_votes(alike, runs, labels), runs)
    found = ops.all_sets_agreement_bits(ops.bit_votes(alike, runs, labels), runs, alike.count())
    assert sorted(map(tuple, found.select(expected.columns).collect())) == sorted(map(tuple, expected.collect()))


def test_prices_by_longest_key_in_force(spark, monkeypatch):
    """Nested keys, changes of price, open and closed ends, missing rates, names and times; with and without broadcast."""
    from tallymark.operators import pricing

    prices = spark.createDataFrame(
        [("GPT", 1.0, 1.0, None, None), ("gpt-5", 2.0, 2.0, "2024-01-01", "2025-01-01"), ("gpt-5", 3.0, 3.0, "2025-01-01", None),
         ("gpt-5-nano", 9.0, None, None, None), ("", 50.0, 50.0, None, None), ("x", 7.0, 7.0, "2030-01-01", None)],
        "model_key string, input_per_million double, output_per_million double, valid_from string, valid_to string",
    )
    usage = spark.createDataFrame(
        [(1, "my-GPT-5", "2024-06-01", 1_000_000), (2, "my-GPT-5", "2025-01-01", 1_000_000), (3, "my-GPT-5", "2023-01-01", 1_000_000),
         (4, "gpt-5-nano", "2024-06-01", 1_000_000), (5, "x", "2024-06-01", 1_000_000), (6, None, "2024-06-01", 5), (7, "gpt", None, 5), (8, "gpt", "2024-06-01", None)],
        "i int, model string, called string, prompt_tokens bigint",
    ).selectExpr("*", "0L AS completion_tokens")
    for most in (100_000, 0):
        monkeypatch.setattr(pricing, "BROADCAST_NAMES", most)
        found = {r["i"]: r["estimated_cost_usd"] for r in ops.price_usage(usage, prices, at="called").collect()}
        assert found == {1: 2.0, 2: 3.0, 3: 1.0, 4: 0.0, 5: 0.0, 6: 0.0, 7: 0.0, 8: 0.0}
    plain = ops.price_usage(usage.where("i = 7"), prices.limit(1).drop("valid_from", "valid_to")).first()
    assert plain["estimated_cost_usd"] == 0.000005
    assert ops.price_usage(usage, prices.limit(0)).where("estimated_cost_usd > 0").count() == 0


def test_parts_that_are_no_key_go_before_the_join(spark):
    """No key is lost, also where bits are few, and what else stays is little."""
    from tallymark.operators import pricing

    keys = spark.range(3000).selectExpr("concat('model-', id * 7) AS _key")
    parts = spark.range(21000).selectExpr("id", "concat('model-', id) AS _key")
    kept = pricing._perhaps_keys(parts, keys, 3000)
    ids = {r["id"] for r in kept.collect()}
    assert kept.columns == ["id", "_key"] and ids >= set(range(0, 21000, 7)) and len(ids) < 4500


def test_prices_of_shorter_keys_count_in_the_gaps_of_longer_ones(spark):
    prices = spark.createDataFrame(
        [("m", 1.0, None, None), ("m-1", 2.0, None, "2024-01-01"), ("m-1", 3.0, "2024-02-01", None),
         ("m-12", 4.0, None, "2023-06-01"), ("m-12", 5.0, "2023-01-01", "2023-09-01"), ("m-123", 6.0, "2025-01-01", "2024-01-01")],
        "model_key string, input_per_million double, valid_from string, valid_to string",
    ).selectExpr("*", "0D AS output_per_million")
    days = ["2022-01-01", "2023-03-01", "2023-07-01", "2023-10-01", "2024-01-15", "2024-03-01"]
    usage = spark.createDataFrame([(d, f"v/M-1{tail}", 1_000_000) for d in days for tail in ("", "23")], "called string, model string, prompt_tokens bigint")
    rows = ops.price_usage(usage.selectExpr("*", "0L AS completion_tokens"), prices, at="called").collect()
    found = {(r["called"], r["model"]): r["estimated_cost_usd"] for r in rows}
    assert [found[d, "v/M-1"] for d in days] == [2.0, 2.0, 2.0, 2.0, 1.0, 3.0]
    assert [found[d, "v/M-123"] for d in days] == [4.0, 5.0, 5.0, 2.0, 1.0, 3.0]


def test_sketches_stay_within_their_errors(spark):
    """Far more IDs than a sketch holds, in parts; exact while it holds them all."""
    left = spark.range(60_000).selectExpr("concat('v', id) AS VolumeName", "id % 4 AS part", "id * 1.5 AS seconds")
    right = spark.range(20_000, 90_000).selectExpr("concat('v', id, '_1.nii.gz') AS VolumeName", "id % 4 AS part")
    sketched = [ops.id_sketches(df, ["part"], log_ids=12) for df in (left, right)]
    row = ops.overlap(*sketched, log_ids=12).first()
    assert 0 < row["error"] < 2_000
    for name, exact in (("matched", 40_000), ("left_only", 20_000), ("right_only", 30_000), ("ids", 90_000)):
        assert abs(row[name] - exact) < 5 * row["error"]
    whole = [ops.id_sketches(df, ["part"], log_ids=18) for df in (left, right)]
    assert tuple(ops.overlap(*whole, log_ids=18).first()) == (40_000, 20_000, 30_000, 90_000, 0.0)
    found = ops.quantiles(ops.value_sketches(left, "seconds", ["part"], k=200), [0.1, 0.5, 0.9]).first()
    assert found["n"] == 60_000
    for rank in (0.1, 0.5, 0.9):
        assert abs(found[f"q{rank:g}"] / 1.5 / 60_000 - rank) < 0.03


def test_stored_runs_are_aligned_without_a_shuffle(spark, tmp_path):
    from tallymark import sources

    rows = [(f"v{i % 40}_1.nii.gz", i % 2, str(i % 3 % 2), i) for i in range(60)]
    df = spark.createDataFrame(rows, "VolumeName string, a int, b string, _ord bigint")
    runs = {"x": df, "y": df.where("_ord % 7 > 0"), "z": df.selectExpr("VolumeName", "1 - a AS a", "b", "_ord")}
    stored = {name: sources.store_run(run, f"stored_{name}", str(tmp_path / name), ["a", "b"], buckets=4) for name, run in runs.items()}
    found = sources.align_stored(stored, ["a", "b"])
    expected = ops.align_runs(runs, ["a", "b"])
    assert sorted(map(tuple, found.select(expected.columns).collect())) == sorted(map(tuple, expected.collect()))
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    spark.sql("DROP TABLE stored_x")
    again = {**stored, "x": sources.open_run(spark, "stored_x", str(tmp_path / "x"), buckets=4)}
    plan = sources.align_stored(again, ["a", "b"])
    assert plan.count() == expected.count() and "Exchange" not in plan._jdf.queryExecution().executedPlan().toString()
    for name in stored:
        spark.sql(f"DROP TABLE stored_{name}")
