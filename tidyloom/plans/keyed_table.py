"""The usual first step of a table flow: clean names, a stable key, plain numbers."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame

from ..operators import clean_column_names, clean_dtypes, get_hashed_column


def keyed_table(
    df: DataFrame, cols: Iterable[str], hash_name: str, zero_override: bool = False
) -> DataFrame:
    """``df`` with canonical names, ``hash_name`` over ``cols`` and decimals as doubles.

    One projection over the scan, without a shuffle.  The key is taken before decimals turn into
    doubles, so that it rests on the exact values.
    """
    return (
        df.transform(clean_column_names)
        .transform(get_hashed_column, cols, hash_name, zero_override)
        .transform(clean_dtypes)
    )
