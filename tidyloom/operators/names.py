"""Renaming whole tables: one ``select`` of aliases, so pushdown and pruning pass straight through."""

from __future__ import annotations

from collections import Counter
from collections.abc import Mapping

from pyspark.sql import DataFrame

from ..functions.keys import column
from ..functions.names import clean_column_name


def clean_column_names(df: DataFrame) -> DataFrame:
    """Every column under its canonical name; empty or clashing results are refused."""
    names = [clean_column_name(name) for name in df.columns]
    _refuse_unusable(df.columns, names)
    return df.toDF(*names)


def rename_cols(df: DataFrame, rename_dict: Mapping[str, str]) -> DataFrame:
    """Rename the columns that exist, all at once and by exact name; other entries are ignored."""
    names = [rename_dict.get(name, name) for name in df.columns]
    if names == df.columns:
        return df
    _refuse_unusable(df.columns, names)
    return df.select(*[column(old).alias(new) for old, new in zip(df.columns, names)])


def _refuse_unusable(before: list[str], after: list[str]) -> None:
    empty = [old for old, new in zip(before, after) if not new]
    if empty:
        raise ValueError(f"no name is left for columns {empty}")
    # Spark resolves names, and file formats store them, without regard to case.
    counts = Counter(new.lower() for new in after)
    clashes = {new: old for old, new in zip(before, after) if counts[new.lower()] > 1}
    if clashes:
        raise ValueError(f"several columns would be named {sorted(clashes)}")
