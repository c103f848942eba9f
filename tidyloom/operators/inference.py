"""Types of text columns, decided by all of their values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.keys import column

_WHOLE = r"^[+-]?(0|[1-9][0-9]*)$"
_NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"
_DATE = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$"
_TIME = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}[T ][0-9]{2}:[0-9]{2}(:[0-9]{2}(\.[0-9]{1,6})?)?$"

#: The lattice: a column has the first type that all of its values fit.
TYPES = ("boolean", "bigint", "decimal(38,0)", "double", "date", "timestamp_ntz")


def _fits(text: Column) -> dict[str, Column]:
    whole, number = text.rlike(_WHOLE), text.rlike(_NUMBER)
    # A number with a leading zero, such as a postal code, would not print as it is written.
    padded = text.rlike(r"^[+-]?0[0-9]")
    return {
        "boolean": F.lower(text).isin("true", "false"),
        "bigint": whole & text.try_cast("bigint").isNotNull(),
        "decimal(38,0)": whole & text.try_cast("decimal(38,0)").isNotNull(),
        # Whole numbers that doubles cannot hold keep the column from becoming one.
        "double": number & ~padded & (~whole | (F.abs(text.try_cast("decimal(38,0)")) <= 2**53)),
        "date": text.rlike(_DATE) & text.try_cast("date").isNotNull(),
        "timestamp_ntz": (text.rlike(_TIME) | text.rlike(_DATE)) & text.try_cast("timestamp_ntz").isNotNull(),
    }


def inferred_types(df: DataFrame) -> dict[str, str]:
    """The type of each text column of ``df``, from one aggregate over all rows; a column without values is text."""
    texts = [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]
    if not texts:
        return {}
    sums = []
    for i, name in enumerate(texts):
        text = F.nullif(F.trim(column(name)), F.lit(""))
        fits = _fits(text)
        sums += [F.count(text).alias(f"n{i}"), *(F.bool_and(F.when(text.isNotNull(), F.coalesce(fits[t], F.lit(False)))).alias(f"t{i}_{k}") for k, t in enumerate(TYPES))]
    found = df.agg(*sums).head()
    return {name: next((t for k, t in enumerate(TYPES) if found[f"n{i}"] and found[f"t{i}_{k}"]), "string") for i, name in enumerate(texts)}


def infer_types(df: DataFrame) -> DataFrame:
    """``df`` with each text column in the first type that fits all of its values: boolean, whole number, number, date, time.

    No sample: the last row may decide.  Blanks around a value do not count, and blank values are null unless the column stays
    text.  Whole numbers beyond 64 bits are decimals; numbers with leading zeros are text.  The types come from a
    job of their own.
    """
    types = inferred_types(df)
    return df.select(
        *[
            F.nullif(F.trim(column(f.name)), F.lit("")).cast(types[f.name]).alias(f.name)
            if types.get(f.name, "string") != "string"
            else column(f.name)
            for f in df.schema
        ]
    )
