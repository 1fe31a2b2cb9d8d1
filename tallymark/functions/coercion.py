"""Column expressions that turn loosely typed values into numbers and text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The characters a Unicode-aware strip() removes.
UNICODE_SPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
    "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)

# A plain decimal number. The JVM parser alone would also take "1d" and hex floats.
_DECIMAL = r"\A[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\z"

_INT_MAX = 2147483647
_INT_MIN = -2147483648


def strip_space(text: Column) -> Column:
    """Trim Unicode whitespace on both ends (SQL trim only removes U+0020).

    A trim with a character list looks at the ends only; a regular expression
    would walk through the whole report.
    """
    return F.btrim(text, F.lit(UNICODE_SPACE))


def is_blank(text: Column) -> Column:
    """True for null or whitespace-only text."""
    return text.isNull() | (strip_space(text) == "")


def parse_number(text: Column) -> Column:
    """A decimal string as DOUBLE, null when it is not one."""
    bare = strip_space(text)
    return F.when(bare.rlike(_DECIMAL), bare.try_cast("double"))


def to_binary_int(value: Column, dtype: T.DataType) -> Column:
    """Label value as INT: null, text and non-finite become 0, fractions are cut.

    Integers other than 0 and 1 survive. Values beyond INT are held at its
    limits, so they stay "neither 0 nor 1".
    """
    if isinstance(dtype, (T.IntegerType, T.ShortType, T.ByteType, T.BooleanType)):
        return F.coalesce(value.cast("int"), F.lit(0))
    if isinstance(dtype, T.LongType):
        # least and greatest ignore nulls, so those go first.
        known = F.coalesce(value, F.lit(0))
        return F.greatest(F.least(known, F.lit(_INT_MAX)), F.lit(_INT_MIN)).cast("int")
    if isinstance(dtype, T.StringType):
        number = parse_number(value)
    elif isinstance(dtype, T.NumericType):
        number = value.cast("double")
    else:
        return F.lit(0)
    usable = number.isNotNull() & ~F.isnan(number) & (F.abs(number) != F.lit(float("inf")))
    held = F.greatest(F.least(number, F.lit(float(_INT_MAX))), F.lit(float(_INT_MIN)))
    return F.when(usable, held.cast("int")).otherwise(F.lit(0))


def safe_number(value: Column, dtype: T.DataType, default: float = 0.0) -> Column:
    """Any value as DOUBLE, with a default for null and unparsable input."""
    if isinstance(dtype, T.StringType):
        number = parse_number(value)
    elif isinstance(dtype, (T.NumericType, T.BooleanType)):
        number = value.cast("double")
    else:
        number = F.lit(None).cast("double")
    return F.coalesce(F.when(~F.isnan(number), number), F.lit(float(default)))


def text_or_empty(value: Column) -> Column:
    return F.coalesce(value.cast("string"), F.lit(""))


def round_half_even(value: Column, places: int) -> Column:
    """Scale, round half to even, scale back, all in DOUBLE.

    This is how array libraries round; ``bround`` goes through the shortest
    decimal text of the number and differs on near ties such as the mean of
    0.7419 and 0.7368.
    """
    scale = F.lit(float(10**places))
    return F.rint(value * scale) / scale


def round4(value: Column) -> Column:
    """The four-place rounding of every reported rate."""
    return round_half_even(value, 4)


def ratio(part: Column, whole: Column) -> Column:
    """part / whole as DOUBLE, 0.0 where whole is 0."""
    return F.when(whole > 0, part.cast("double") / whole.cast("double")).otherwise(F.lit(0.0))
