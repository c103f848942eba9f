"""Tables from files, documents, pages and queries."""

from .fixed_width import read_fixed_width
from .html import html_table_rows, html_tables
from .inventory import (
    entry_summary,
    file_inventory,
    is_exists,
    is_require_filename,
    missing_inputs,
)
from .tables import load_data, load_inputs, register_file_sources

__all__ = [
    "entry_summary",
    "file_inventory",
    "html_table_rows",
    "html_tables",
    "is_exists",
    "is_require_filename",
    "load_data",
    "load_inputs",
    "missing_inputs",
    "read_fixed_width",
    "register_file_sources",
]
