import hashlib

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallymark.functions import (
    IdRule,
    PromptSpec,
    active_labels,
    build_messages,
    build_report_text,
    estimate_cost,
    is_blank,
    label_value,
    parse_object,
    report_hash,
    report_length,
    response_error,
    round4,
    safe_number,
    scan_id,
    strip_code_fence,
    strip_suffixes,
    to_binary_int,
    total_tokens,
)


def evaluate(spark, values, expression, kind="string"):
    """Value of ``expression(column)`` for each input, in order."""
    df = spark.createDataFrame(list(enumerate(values)), f"i int, v {kind}")
    return [r[0] for r in df.orderBy("i").select(expression(F.col("v"))).collect()]


def test_text_is_coerced_to_label_values(spark):
    values = ["0.9", " 1 ", "2", "True", "1d", "0x1p3", "inf", "nan", None, "1e3", "abc", "-1.7", "9" * 12]
    got = evaluate(spark, values, lambda v: to_binary_int(v, T.StringType()))
    assert got == [0, 1, 2, 0, 0, 0, 0, 0, 0, 1000, 0, -1, 2147483647]


def test_numbers_and_booleans_are_coerced(spark):
    doubles = [0.99, 1.0, float("nan"), float("inf"), None, -2.5]
    assert evaluate(spark, doubles, lambda v: to_binary_int(v, T.DoubleType()), "double") == [0, 1, 0, 0, 0, -2]
    assert evaluate(spark, [True, False, None], lambda v: to_binary_int(v, T.BooleanType()), "boolean") == [1, 0, 0]
    assert evaluate(spark, [5, None, 2**40], lambda v: to_binary_int(v, T.LongType()), "bigint") == [5, 0, 2147483647]


def test_safe_number_defaults(spark):
    got = evaluate(spark, ["3.5", "x", None, "nan"], lambda v: safe_number(v, T.StringType(), 9))
    assert got == [3.5, 9.0, 9.0, 9.0]


@pytest.mark.parametrize(
    "text, blank",
    [(None, True), ("", True), (" \t\n", True), ("  \x1c", True), (" x ", False), ("​", False)],
)
def test_blank_reports(spark, text, blank):
    assert evaluate(spark, [text], is_blank) == [blank]


def test_first_listed_suffix_is_dropped_once(spark):
    values = ["a.nii.gz", "a.nii", "a.nii.nii.gz", "a.gz", None, "x.nii.gz_3"]
    assert evaluate(spark, values, strip_suffixes) == ["a", "a", "a.nii", "a.gz", None, "x.nii.gz_3"]
    assert evaluate(spark, ["a.b.c"], lambda v: strip_suffixes(v, [".c", ".b.c"])) == ["a.b"]


def test_id_rule(spark):
    values = ["scan_1.nii.gz", "scan_12", "scan_a", "scan_1_2.nii", None, "scan_1\n", "_5", "a_", "5", "é_07"]
    assert evaluate(spark, values, IdRule().apply) == [
        "scan", "scan", "scan_a", "scan_1", "nan", "scan_1\n", "", "a_", "5", "é",
    ]
    kept = IdRule(keep_reconstruction_suffix=True)
    assert evaluate(spark, values[:2], kept.apply) == ["scan_1", "scan_12"]


def test_scan_id_keeps_other_names(spark):
    values = ["train_1_a_2.nii.gz", "train_1_a_2.nii", "train", None]
    assert evaluate(spark, values, scan_id) == ["train_1_a", "train_1_a_2.nii", "train", ""]


def test_report_text_joins_non_blank_parts(spark):
    df = spark.createDataFrame([(" a\n", "", " b "), (None, " ", None)], "x string, y string, z string")
    text = build_report_text([F.col("x"), F.col("y"), F.col("z")])
    assert [r[0] for r in df.select(text).collect()] == ["a\n\nb", ""]


def test_hash_and_length(spark):
    assert evaluate(spark, ["é\U0001f600", None], report_length) == [2, 0]
    expected = hashlib.sha256("é\U0001f600".encode()).hexdigest()
    assert evaluate(spark, ["é\U0001f600", None], report_hash) == [expected, ""]


def parse(spark, text, label="Label_A"):
    body = strip_code_fence(F.col("v"))
    df = spark.createDataFrame([(text,)], "v string").select(body.alias("body"))
    df = df.withColumn("parsed", parse_object(F.col("body")))
    error = response_error(F.col("body"), F.col("parsed"))
    return tuple(df.select(error, label_value(F.col("parsed"), F.lit(label))).first())


@pytest.mark.parametrize(
    "text, value",
    [
        ('{"Label_A": 1, "Label_B": 0}', 1),
        ('{"Label_B": 0}', 0),
        ('{"Label_A": 1, "Extra": 1}', 1),
        ('{"Label_A": "1"}', 1),
        ('{"Label_A": "Present"}', 1),
        ('{"Label_A": 5}', 1),
        ('{"Label_A": null}', 0),
        ('{"Label_A": "junk"}', 0),
        ('{"Label_A": "5"}', 0),
        ('{"Label_A": 1.0}', 0),
        ('{"Label_A": true}', 1),
        ('{"Label_A": [1]}', 0),
        ('{"label_a": " YES "}', 1),
        ('{"Label_A": null, "LABEL_A": 1}', 1),
        ('{"Label_A": 0, "label_a": 1}', 0),
        ('{"Label_A": 0, "Label_A": 1}', 1),
        ('```json\n{"Label_A": 1}\n```', 1),
        ('before ```{"Label_A": "positive"}``` after', 1),
        ('{"Label_A": 1, "note": "a ] b"}', 1),
    ],
)
def test_answers(spark, text, value):
    assert parse(spark, text) == ("", value)


@pytest.mark.parametrize(
    "text",
    ["", "not json", "```\nnot json\n```", '{"Label_A": 1} x', '{"Label_A": 1}] [', "{'Label_A': 1}", '{"Label_A": 1},{}', '{"Label_A": 1,}'],
)
def test_malformed_answers(spark, text):
    assert parse(spark, text) == ("Malformed JSON response", 0)


@pytest.mark.parametrize(
    "text, kind",
    [("[1]", "list"), ("5", "int"), ("1.5", "float"), ('"s"', "str"), ("true", "bool"), ("null", "NoneType")],
)
def test_answers_that_are_no_object(spark, text, kind):
    assert parse(spark, text) == (f"'{kind}' object has no attribute 'items'", 0)


def test_active_labels():
    assert active_labels(None, ["a"]) == ["a"]
    assert active_labels(" b ", ["a"]) == ["b"]
    assert active_labels(["", " c "], ["a"]) == ["c"]
    assert active_labels(["", " "], ["a"]) == ["a"]


def test_messages(spark):
    prompt = PromptSpec(
        "Be exact.",
        ("Label_A", "Label_B"),
        examples=(
            {"report": "old", "output": {"Label_A": 0, "Label_B": 1}},
            {"report": "text", "output": '{"Label_B": 1}'},
            {"report": "free", "output": "none"},
        ),
    )
    df = spark.createDataFrame([("new",)], "v string")
    both = df.select(build_messages(F.col("v"), prompt)).first()[0]
    assert [m["role"] for m in both] == ["system", "user", "assistant", "user", "assistant", "user", "assistant", "user"]
    assert both[0]["content"] == "Be exact."
    assert both[2]["content"] == '{"Label_A": 0, "Label_B": 1}'
    assert both[6]["content"] == "none"
    assert both[7]["content"] == (
        'Report:\n"""\nnew\n"""\n\nTarget findings:\n- Label_A\n- Label_B\n'
        "Return a JSON object that only contains these findings as keys with 0/1 values."
    )
    one = df.select(build_messages(F.col("v"), prompt, ["Label_A"])).first()[0]
    assert "- Label_B" not in one[-1]["content"]
    assert (one[2]["content"], one[4]["content"]) == ('{"Label_A": 0}', "{}")
    quiet = PromptSpec("s", ("Label_A",), examples=prompt.examples, examples_enabled=False)
    assert len(df.select(build_messages(F.col("v"), quiet)).first()[0]) == 2


def test_prompt_spec_checks_mode():
    with pytest.raises(ValueError):
        PromptSpec("s", ("a",), mode="both")


def cost(spark, model, prompt, completion, pricing):
    value = estimate_cost(F.lit(model), F.lit(prompt), F.lit(completion), pricing)
    return spark.range(1).select(value).first()[0]


def test_cost(spark):
    table = {
        "gpt-4": {"input_per_million": 30.0, "output_per_million": 60.0},
        "GPT-4-turbo": {"input_per_million": 10.0, "output_per_million": 30.0},
        "gpt-4-turbo-x": {"input_per_million": 1.0},
    }
    assert cost(spark, "m", 1, 1, {}) == 0.0
    assert cost(spark, "m", 1, 1, None) == 0.0
    assert cost(spark, "other", 100, 50, table) == 0.0
    assert cost(spark, "gpt-4-turbo-preview", 1_000_000, 1_000_000, table) == 40.0
    assert cost(spark, "gpt-4-turbo-x1", 5, 5, table) == 0.0
    assert cost(spark, "gpt-5-nano", 100, 10, {"gpt-5-nano": {"input_per_million": 0.05, "output_per_million": 0.4}}) == 0.000009


def test_total_tokens(spark):
    df = spark.createDataFrame([(None, 2, 3), (0, 2, 3), (9, 2, 3)], "t int, p int, c int")
    got = df.select(total_tokens(F.col("t"), F.col("p"), F.col("c"))).collect()
    assert [r[0] for r in got] == [5, 5, 9]


def test_rounding_is_half_even_after_scaling(spark):
    got = evaluate(spark, [0.00625, 0.73935, 2 / 3], round4, "double")
    assert got == [0.0062, 0.7393, 0.6667]


@pytest.mark.parametrize("value, bit", [("99999999999999999999", 1), ("-10000000000000000000000", 1), ("1.0", 0), ("1e30", 0), ("9223372036854775807", 1)])
def test_integers_beyond_64_bits_are_integers(spark, value, bit):
    df = spark.createDataFrame([(f'{{"k": {value}}}',)], "body string")
    df = df.withColumn("parsed", parse_object(F.col("body")))
    assert df.select(label_value(F.col("parsed"), F.lit("k"))).first()[0] == bit
