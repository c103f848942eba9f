"""Stable integer keys from several columns, and the all-zero test."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import plain_text


def column(name: str) -> Column:
    """A column by its exact name, dots and backticks included."""
    return F.col("`" + name.replace("`", "``") + "`")


def all_zero(df: DataFrame, cols: Iterable[str]) -> Column:
    """True where every listed column is 0 (false counts as 0); never null.

    Null, NaN and non-numeric columns are not zero.  Used in ``filter``, each comparison reaches the
    Parquet scan.
    """
    tests = [_is_zero(column(name), df.schema[name].dataType) for name in _names(cols)]
    return reduce(lambda left, right: left & right, tests)


def _is_zero(col: Column, dtype: T.DataType) -> Column:
    if isinstance(dtype, T.BooleanType):
        return col.eqNullSafe(F.lit(False))
    if isinstance(dtype, (T.DoubleType, T.FloatType)):
        # A Parquet scan takes 0.0 and -0.0 for different values, so it is told both.
        return col.eqNullSafe(F.lit(0.0).cast(dtype)) | col.eqNullSafe(F.lit(-0.0).cast(dtype))
    if isinstance(dtype, T.NumericType):
        return col.eqNullSafe(F.lit(0))
    return F.lit(False)


def key_text(df: DataFrame, cols: Iterable[str], nulls: str = "null", sep: str = "") -> Column:
    """``value1 || name1 || value2 || name2 ...`` with the columns in name order."""
    if nulls not in ("null", "text"):
        raise ValueError("nulls must be 'null' (a null gives a null key) or 'text'")
    parts = []
    for name in sorted(_names(cols)):
        dtype = df.schema[name].dataType
        value = plain_text(column(name), dtype)
        if nulls == "text":
            missing = "nan" if isinstance(dtype, (T.DoubleType, T.FloatType)) else "None"
            value = F.coalesce(value, F.lit(missing))
        parts += [value, F.lit(name)]
    if not sep:
        return F.concat(*parts)
    spaced = [piece for part in parts for piece in (F.lit(sep), part)]
    return F.concat(*spaced[1:])


def hash_key(text: Column) -> Column:
    """The first 60 bits of SHA-256 as a non-negative ``bigint``."""
    return F.conv(F.substring(F.sha2(text, 256), 1, 15), 16, 10).cast("bigint")


def _names(cols: Iterable[str]) -> list[str]:
    names = [cols] if isinstance(cols, str) else list(cols)
    if not names:
        raise ValueError("at least one column is needed")
    return names
