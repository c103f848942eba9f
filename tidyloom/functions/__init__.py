"""Column functions: columns in, columns out."""

from .fingerprints import canonical_json, get_hash_str, record_json, row_hash_str
from .keys import all_zero, column, hash_key, key_text
from .levels import clean_level, get_num_value
from .names import clean_column_name, clean_label
from .numbers import convert_value
from .text import float_text, iso_text, plain_text
from .udf import py_or_udf
from .urls import split_url, url_bucket, url_key, url_text

__all__ = [
    "all_zero",
    "canonical_json",
    "clean_column_name",
    "clean_label",
    "clean_level",
    "column",
    "convert_value",
    "float_text",
    "get_hash_str",
    "get_num_value",
    "hash_key",
    "iso_text",
    "key_text",
    "plain_text",
    "py_or_udf",
    "record_json",
    "row_hash_str",
    "split_url",
    "url_bucket",
    "url_key",
    "url_text",
]
