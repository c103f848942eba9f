"""Table operators: tables in, tables out; chain them with ``df.transform``."""

from .checks import broken_rows, observe_checks, stop_at_broken
from .dtypes import clean_dtypes, replace_decimals, to_pandas_safe
from .inference import infer_types, inferred_types
from .keys import get_hashed_column, with_hash_str
from .names import clean_column_names, rename_cols

__all__ = [
    "broken_rows",
    "clean_column_names",
    "clean_dtypes",
    "get_hashed_column",
    "infer_types",
    "inferred_types",
    "observe_checks",
    "rename_cols",
    "replace_decimals",
    "stop_at_broken",
    "to_pandas_safe",
    "with_hash_str",
]
