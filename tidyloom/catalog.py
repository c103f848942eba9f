"""Named entries: where a table lives, its format, and its load and save options.

A catalog is a plain dict, for instance read from YAML::

    {"orders": {"file_path": "s3a://bucket/orders", "file_format": "parquet",
                "load": {"mergeSchema": True}, "save": {"partitionBy": "o_orderstatus"}}}
"""

from __future__ import annotations

from collections.abc import Mapping
from typing import Any

# Keys that locate the table; they are never reader or writer options.
LOCATION_KEYS = frozenset({"file_path", "file_format"})

# Switches that older catalogs carry and no reader or writer understands.
IGNORED_KEYS = frozenset({"run_ge", "pd_df", "pl_df", "spark"})
IGNORED_SAVE_KEYS = frozenset(
    {
        "to_tableau",
        "tableau_env",
        "project_name",
        "project_id",
        "tableau_secret_name",
        "parent_project_name",
    }
)

# Formats of other catalogs that this library refuses to read or write.
REFUSED_FORMATS = frozenset({"pkl", "pickle", "clipboard", "hdf", "sas", "spss", "gbq", "latex"})


def find_entry(catalog: Mapping[str, Mapping], name: str) -> Mapping[str, Any]:
    if name not in catalog:
        raise KeyError(f"no entry named {name!r}; there are {sorted(catalog)}")
    return catalog[name]


def join_path(root: str, suffix: str | None = None) -> str:
    """``suffix`` under ``root``, with exactly one slash between them."""
    return f"{root.rstrip('/')}/{suffix.lstrip('/')}" if suffix else root


def merge_options(entry: Mapping[str, Any], kind: str, overrides: Mapping[str, Any]) -> dict:
    """The entry's options for ``kind`` (``load`` or ``save``) under those of the call."""
    merged = {**(entry.get(kind) or {}), **overrides}
    dropped = LOCATION_KEYS | IGNORED_KEYS
    if kind == "save":
        dropped |= IGNORED_SAVE_KEYS
    return {key: value for key, value in merged.items() if key not in dropped and value is not None}


def table_format(entry: Mapping[str, Any], path: str) -> str:
    """The entry's format in lower case; a ``.json`` file name wins over it."""
    fmt = "json" if path.endswith(".json") else entry["file_format"].lower()
    if fmt in REFUSED_FORMATS or path.endswith((".pkl", ".pickle")):
        raise ValueError(f"{path}: format {fmt!r} cannot be read or written as a distributed table")
    return fmt


def get_input_paths(
    catalog: Mapping[str, Mapping], input_filenames: Mapping[str, str | None]
) -> dict:
    """``{"path_to_<entry>": entry}`` with each path extended by its file name, if it has one."""
    return {
        f"path_to_{name}": {
            **find_entry(catalog, name),
            "file_path": join_path(find_entry(catalog, name)["file_path"], filename),
        }
        for name, filename in input_filenames.items()
    }


def get_input_info(
    catalog: Mapping[str, Mapping], input_filenames: Mapping[str, str | None]
) -> dict:
    """``{"input_info": {entry: {"file_path", "file_format"}}}`` for several inputs."""
    return {
        "input_info": {
            name: {
                "file_path": join_path(find_entry(catalog, name)["file_path"], filename),
                "file_format": find_entry(catalog, name)["file_format"],
            }
            for name, filename in input_filenames.items()
        }
    }
