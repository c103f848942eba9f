"""Canonical text of a value: the same on every JVM, the same as Python's ``str`` for numbers.

Hashes and fingerprints are built on these texts, so a text may never depend on the Java release,
the session time zone or a column's neighbours.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Significant digits of the longest shortest text, and the format that leaves one of them out.  Java
# releases before 19 print some numbers with a digit too many, such as 9.4349823432545455 for
# 9.434982343254546, always at this length unless the number is very large or very small.
_FULL_DIGITS = {T.DoubleType: (17, "%.15e"), T.FloatType: (9, "%.7e")}

# 16 digits before the point and 22 after it hold every number that is written without an exponent.
_PLAIN = "decimal(38,22)"


def float_text(col: Column, dtype: T.DataType, nan: str = "nan", inf: str = "inf") -> Column:
    """Shortest decimal text that reads back as the same number: ``10000000.0``, ``1e+16``, ``1.5e-07``.

    Most values take the first branch, where Spark's own text already has that form.  From 1e-8 to
    1e16 the text is always the shortest one; outside, a 17th digit can remain.  32-bit numbers from
    1e7 to 1e16, all of them whole, are written in full.
    """
    text = col.cast("string")
    size = F.abs(col)
    digits, _ = _FULL_DIGITS[type(dtype)]
    # Of that many characters one is the point, so the number has fewer digits.
    short = (F.length(text) <= digits) & (size >= 1e-3) & (size < 1e7)
    # The other forms are kept out of the generated code, which would outgrow the JVM's compiler.
    pair = F.array(F.struct(col.alias("number"), text.alias("text")))
    rare = F.transform(
        pair, lambda v: _rare_float_text(v["number"], v["text"], dtype, nan, inf)
    )
    return F.when(short | (size == 0), text).otherwise(F.element_at(rare, 1))


def _rare_float_text(col: Column, text: Column, dtype: T.DataType, nan: str, inf: str) -> Column:
    size = F.abs(col)
    digits, less = _FULL_DIGITS[type(dtype)]
    shorter = F.format_string(less, col.cast("double"))
    mantissa = F.replace(F.substring_index(text, "E", 1), F.lit("."), F.lit(""))
    is_long = F.length(F.ltrim(mantissa, F.lit("-0"))) >= digits
    limit = 1e16 if isinstance(dtype, T.DoubleType) else 1e7
    return (
        F.when(
            (size >= 1e-4) & (size < limit) & is_long & (shorter.try_cast(dtype) == col),
            _without_exponent(shorter),
        )
        .when((size >= 1e-3) & (size < 1e7), text)
        .when((size >= 1e7) & (size < 1e16), _shifted_point(col, text))
        .when((size >= 1e-4) & (size < 1e-3), _without_exponent(text))
        .otherwise(_other_float_text(col, text, dtype, nan, inf))
    )


def _without_exponent(text: Column) -> Column:
    """A number up to 1e16 as digits and a point; zeros at the end go, but for one after the point."""
    return F.regexp_replace(text.try_cast(_PLAIN).cast("string"), r"(\.\d+?)0+$", "$1")


def _shifted_point(col: Column, text: Column) -> Column:
    """``1.2345678E7`` as ``12345678.0``: the whole part as an integer, then the digits left over."""
    whole = col.try_cast("bigint").cast("string")
    mantissa = F.substring_index(text, "E", 1)
    # The mantissa has its point after one digit, so it holds the whole part in one place more.
    taken = F.length(whole) + 1
    rest = F.substring(mantissa, taken + 1, F.lit(20))
    return F.concat(
        whole, F.lit("."), F.when(F.length(mantissa) > taken, rest).otherwise("0")
    )


def _other_float_text(col: Column, text: Column, dtype: T.DataType, nan: str, inf: str) -> Column:
    """Numbers written with an exponent, and those that are none."""
    digits = F.length(F.regexp_replace(text, r"E.*$|\D", ""))
    pattern = F.concat(F.lit("%."), F.greatest(digits - 2, F.lit(0)).cast("string"), F.lit("e"))
    shorter = F.call_function("format_string", pattern, col.cast("double"))
    number = F.when(shorter.try_cast(dtype) == col, shorter).otherwise(text)
    for found, replacement in (
        (r"E(?=\d)", "e+"),
        (r"E", "e"),
        (r"\.?0*e", "e"),  # 1.50e and 1.0e as 1.5e and 1e
        (r"(?<sign>[+-])(?<digit>\d)$", "${sign}0${digit}"),  # two digits at least
    ):
        number = F.regexp_replace(number, found, replacement)
    return (
        F.when(F.isnan(col), nan)
        .when(text == "Infinity", inf)
        .when(text == "-Infinity", "-" + inf)
        .otherwise(number)
    )


def time_text(col: Column, dtype: T.DataType) -> Column:
    """``2020-01-02 03:04:05``; the fraction is left out when zero and has six digits otherwise.

    Instants (time-zone-aware timestamps) are written in UTC, so the text does not follow the session time zone.
    """
    if isinstance(dtype, T.TimestampType):
        epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
        col = F.timestamp_add("MICROSECOND", F.unix_micros(col), epoch)
    # A plain cast: formatting functions would go through the session time zone.
    text = col.cast("string")
    point = F.instr(text, ".")
    return F.when(point > 0, F.rpad(text, point + 6, "0")).otherwise(text)


def iso_text(col: Column, dtype: T.DataType) -> Column:
    """ISO-8601 text; that of an instant ends with its offset."""
    if isinstance(dtype, T.DateType):
        return col.cast("string")
    text = F.translate(time_text(col, dtype), " ", "T")
    return F.concat(text, F.lit("+00:00")) if isinstance(dtype, T.TimestampType) else text


def plain_text(col: Column, dtype: T.DataType) -> Column:
    """Text of a scalar column; null stays null."""
    if isinstance(dtype, (T.DoubleType, T.FloatType)):
        return float_text(col, dtype)
    if isinstance(dtype, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return iso_text(col, dtype)
    if isinstance(dtype, (T.ArrayType, T.MapType, T.StructType, T.BinaryType, T.VariantType)):
        raise ValueError(f"a {dtype.simpleString()} column has no plain text; use a record fingerprint")
    return col.cast("string")
