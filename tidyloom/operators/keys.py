"""Tables with a hashed key or a fingerprint added.  No shuffle: each row is hashed where it is."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.fingerprints import row_hash_str
from ..functions.keys import all_zero, hash_key, key_text


def get_hashed_column(
    df: DataFrame,
    cols: Iterable[str],
    hash_name: str,
    zero_override: bool = False,
    nulls: str = "null",
    sep: str = "",
) -> DataFrame:
    """Add ``hash_name``: a ``bigint`` made from the values and names of ``cols``, in any order.

    ``zero_override`` writes 0 where all columns are 0.  ``nulls="null"`` gives a null key when any
    value is null, ``nulls="text"`` hashes a null as a value of its own.  Values and names are joined
    without a separator unless ``sep`` names one.
    """
    cols = [cols] if isinstance(cols, str) else list(cols)
    key = hash_key(key_text(df, cols, nulls, sep))
    if zero_override:
        key = F.when(all_zero(df, cols), F.lit(0).cast("bigint")).otherwise(key)
    return df.withColumn(hash_name, key)


def with_hash_str(
    df: DataFrame,
    name: str = "hash_str",
    columns: Iterable[str] | None = None,
    skip: Iterable[str] = (),
    sha512: bool = False,
) -> DataFrame:
    """Add ``name``: the order-insensitive fingerprint of each row."""
    return df.withColumn(name, row_hash_str(df, columns, skip, sha512))
