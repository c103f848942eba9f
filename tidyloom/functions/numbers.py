"""Integer-like text of a value."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .names import BLANKS
from .text import float_text, plain_text, time_text

# Largest magnitude below which every double that is a whole number is exact.
_EXACT_DOUBLE = float(2**53)


def convert_value(col: Column, dtype: T.DataType, none_text: bool = False) -> Column:
    """``3.7`` -> ``"3"``, ``" 3 "`` -> ``"3"``, ``"007"`` -> ``"7"``, ``"abc"`` -> ``"abc"``, true -> ``"1"``.

    Numbers lose their fraction towards zero, integer texts are normalised and everything else keeps
    its text.  Null stays null unless ``none_text`` asks for ``"None"``.  Doubles beyond 2^53 show their
    shortest digits followed by zeros.
    """
    if isinstance(dtype, T.BooleanType):
        text = F.when(col, "1").when(~col, "0")
    elif isinstance(dtype, (T.DoubleType, T.FloatType)):
        text = _whole_part_of_double(col, dtype)
    elif isinstance(dtype, T.DecimalType):
        text = _whole_part_of_decimal(col)
    elif isinstance(dtype, (T.StringType, T.CharType, T.VarcharType)):
        text = _normalised_integer_text(col)
    elif isinstance(dtype, (T.TimestampType, T.TimestampNTZType)):
        text = time_text(col, dtype)
    else:
        text = plain_text(col, dtype)
    return F.coalesce(text, F.lit("None")) if none_text else text


def _whole_part_of_double(col: Column, dtype: T.DataType) -> Column:
    beyond = F.coalesce(
        F.when(~F.isnan(col), col.try_cast("decimal(38,0)").cast("string")),
        float_text(col, dtype),
    )
    small = F.abs(col) < _EXACT_DOUBLE
    return F.when(small, col.try_cast("bigint").cast("string")).otherwise(beyond)


def _whole_part_of_decimal(col: Column) -> Column:
    # Cutting the printed text truncates towards zero at any precision.
    return F.when(F.abs(col) < 1, "0").otherwise(F.substring_index(col.cast("string"), ".", 1))


# Sign, zeros, digits, within blanks; the minus sign of a zero is not kept.  Zeros and digits never compete
# for a character, so a text is passed over once.
_INTEGER = rf"^[{BLANKS}]*(?:\+|-(?=0+[{BLANKS}]*$)|(-))?0*(0|[1-9][0-9]*)[{BLANKS}]*$"
_LAST_OF_INTEGER = rf"[0-9{BLANKS}]"


def _normalised_integer_text(col: Column) -> Column:
    # Any length, as no numeric type is involved; a text that does not match stays as it is.
    ends_well = F.substring(col, -1, 1).rlike(_LAST_OF_INTEGER)
    return F.when(ends_well, F.regexp_replace(col, _INTEGER, "$1$2")).otherwise(col)
