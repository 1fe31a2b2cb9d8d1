"""Model responses: fence removal, strict JSON parsing and 0/1 normalisation.

Everything here is a native expression; JSON value types are kept by reading
the object as MAP<STRING, VARIANT>. Values needed more than once are bound by a
one-element ``transform``, because nothing shares subexpressions around
higher-order functions and the text would be parsed again for every use.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .coercion import strip_space

_FENCE_MARK = "```"
_FENCE = r"(?sU)```(?:json)?\s*(.*?)\s*```"
_OBJECT_LIST = "array<map<string,variant>>"
_JSON_OPTIONS = {"allowSingleQuotes": "false"}

# The words read as a positive finding.
POSITIVE_WORDS = ("1", "yes", "true", "present", "positive")

MALFORMED = "Malformed JSON response"


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def strip_code_fence(text: Column) -> Column:
    """Body of the first triple-backtick fence, or the text itself."""
    fenced = F.contains(text, F.lit(_FENCE_MARK)) & text.rlike(_FENCE)
    return F.when(fenced, F.regexp_extract(text, _FENCE, 1)).otherwise(text)


def parse_object(body: Column) -> Column:
    """Entries of a JSON object; null when the text is anything else.

    An entry is STRUCT<key, folded, bit>: the key, its lower-case form and the
    value as 0/1 (null for JSON null). Repeated keys are repeated entries.

    The parser stops after the first value and ignores what follows, so the
    text is wrapped: inside ``[...]`` trailing junk is an error or a second
    element. Only a text with a bracket of its own could close the list early;
    for those a wrap in ``{...}`` must parse as well.
    """
    listed = F.from_json(F.concat(F.lit("["), body, F.lit("]")), _OBJECT_LIST, _JSON_OPTIONS)
    strict = ~F.contains(body, F.lit("]")) | _fits_in_object(body)

    def entry(e: Column) -> Column:
        return F.struct(
            e["key"].alias("key"), F.lower(e["key"]).alias("folded"), _bit(e["value"]).alias("bit")
        )

    return _let(
        listed,
        lambda values: F.when(
            (F.size(values) == 1) & strict,
            F.transform(F.map_entries(F.element_at(values, 1)), entry),
        ),
    )


def _fits_in_object(body: Column) -> Column:
    wrapped = F.concat(F.lit('{"v":'), body, F.lit("}"))
    return F.size(F.from_json(wrapped, "map<string,string>", _JSON_OPTIONS)) == 1


def response_error(body: Column, parsed: Column) -> Column:
    """Empty for an object, else the message stored with the failed row."""
    values = F.try_parse_json(F.concat(F.lit("["), body, F.lit("]")))

    def only_kind(v: Column) -> Column:
        """JSON type of the text's one value, null when it is not one value."""
        kind = F.schema_of_variant(F.try_variant_get(v, "$[0]", "variant"))
        single = F.try_variant_get(v, "$[1]", "variant").isNull()
        return F.when(single & _fits_in_object(body), kind)

    def message(kind: Column) -> Column:
        python_type = (
            F.when(kind.startswith("ARRAY"), "list")
            .when(kind == "STRING", "str")
            .when(kind == "BOOLEAN", "bool")
            .when(kind == "BIGINT", "int")
            .when(kind == "VOID", "NoneType")
            .when(kind.startswith("DECIMAL") | (kind == "DOUBLE"), "float")
        )
        wrong_type = F.concat(F.lit("'"), python_type, F.lit("' object has no attribute 'items'"))
        return F.coalesce(wrong_type, F.lit(MALFORMED))

    failed = _let(_let(values, only_kind), message)
    return F.when(parsed.isNotNull(), F.lit("")).otherwise(failed)


def _bit(value: Column) -> Column:
    """VARIANT as 0/1, null for JSON null."""

    def by_kind(kind: Column) -> Column:
        word = F.lower(strip_space(F.try_variant_get(value, "$", "string")))
        return (
            F.when(kind == "BIGINT", (F.try_variant_get(value, "$", "bigint") != 0).cast("int"))
            # Integers beyond 64 bits come as decimals without a fraction.
            .when(kind.rlike(r"^DECIMAL\((19|2\d|3\d),0\)$"), (F.try_variant_get(value, "$", "decimal(38,0)") != 0).cast("int"))
            .when(kind == "BOOLEAN", F.try_variant_get(value, "$", "boolean").cast("int"))
            .when(kind == "STRING", word.isin(*POSITIVE_WORDS).cast("int"))
            .when(kind != "VOID", F.lit(0))
        )

    return _let(F.schema_of_variant(value), by_kind)


def normalize_binary(value: Column) -> Column:
    """VARIANT value as 0/1.

    Non-zero integers, true and the positive words are 1; floats, lists,
    objects, null and any other text are 0.
    """
    return F.coalesce(_bit(value), F.lit(0))


def label_value(parsed: Column, label: Column) -> Column:
    """0/1 for one label of a parsed object.

    The exact key wins unless it is missing or null; then any key equal but for
    case. Of repeated keys the last one counts.
    """
    exact = F.try_element_at(F.filter(parsed, lambda e: e["key"] == label), F.lit(-1))
    folded = F.try_element_at(F.filter(parsed, lambda e: e["folded"] == F.lower(label)), F.lit(-1))
    return F.coalesce(exact["bit"], folded["bit"], F.lit(0))
