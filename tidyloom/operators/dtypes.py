"""Decimal columns as floating-point columns, nested ones included, in one ``select``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ..functions.keys import column


def clean_dtypes(df: DataFrame) -> DataFrame:
    """Every decimal as ``double``: the form reporting tools take."""
    return replace_decimals(df, T.DoubleType())


def to_pandas_safe(df: DataFrame, to: T.DataType = T.FloatType()) -> DataFrame:
    """Every decimal as a floating-point number, ready for ``toPandas()`` at the caller.

    The default of 32 bits keeps about seven digits; pass ``DoubleType()`` for about sixteen.
    """
    return replace_decimals(df, to)


def replace_decimals(df: DataFrame, to: T.DataType) -> DataFrame:
    targets = [_without_decimals(field.dataType, to) for field in df.schema]
    if targets == [field.dataType for field in df.schema]:
        return df
    return df.select(
        *[
            column(field.name)
            if target == field.dataType
            else column(field.name).cast(target).alias(field.name, metadata=field.metadata)
            for field, target in zip(df.schema, targets)
        ]
    )


def _without_decimals(dtype: T.DataType, to: T.DataType) -> T.DataType:
    if isinstance(dtype, T.DecimalType):
        return to
    if isinstance(dtype, T.ArrayType):
        return T.ArrayType(_without_decimals(dtype.elementType, to), dtype.containsNull)
    if isinstance(dtype, T.MapType):
        return T.MapType(
            _without_decimals(dtype.keyType, to),
            _without_decimals(dtype.valueType, to),
            dtype.valueContainsNull,
        )
    if isinstance(dtype, T.StructType):
        return T.StructType(
            [
                T.StructField(f.name, _without_decimals(f.dataType, to), f.nullable, f.metadata)
                for f in dtype
            ]
        )
    return dtype
