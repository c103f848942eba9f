"""Saving tables by entry."""

from __future__ import annotations

import json
import os
import re
import uuid
from collections.abc import Mapping
from typing import Any
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, DataFrameWriter
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..catalog import find_entry, join_path, merge_options, table_format
from ..functions.keys import column
from ..operators.checks import observe_checks, stop_at_broken
from ..operators.dtypes import clean_dtypes
from ..sources.feather import FeatherSource

# Formats that can be loaded but have no distributed writer.
READ_ONLY_FORMATS = frozenset({"html", "fwf", "table", "sql_query"})

# Spark's own text formats cut timestamps to milliseconds, and its JSON leaves null columns out.
_FULL_TIMESTAMPS = {
    "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX",
    "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS",
}
# Its csv strips blanks, and marks quotes by a backslash that texts may hold themselves.
_WHOLE_TEXTS = {"ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False, "escape": '"'}
# Without its native library, Hadoop's file system with checksums starts a chmod process for each local file and one for its checksum.
_NO_CHECKSUMS = {"fs.file.impl": "org.apache.hadoop.fs.RawLocalFileSystem", "fs.file.impl.disable.cache": True}
TEXT_DEFAULTS = {
    "csv": {**_FULL_TIMESTAMPS, **_WHOLE_TEXTS},
    "json": {**_FULL_TIMESTAMPS, "ignoreNullFields": False},
    "xml": _FULL_TIMESTAMPS,
}


def save_data(
    df: DataFrame, catalog: Mapping[str, Mapping], catalog_entry: str, **options: Any
) -> dict[str, int] | None:
    """Write a table to its entry; call options win over the entry's ``save`` options.

    Besides the options of the format's writer: ``suffix`` (call only), ``mode`` (``overwrite`` unless
    given), ``partitionBy``, and ``rebalance`` (shuffle by the partition columns first, so that each
    folder gets few, evenly sized files instead of one per task).  With
    ``partitionOverwriteMode="dynamic"`` an overwrite keeps the partitions it does not write.  With ``checksums`` false, files on a
    local or mounted disk are written without Hadoop's checksum files beside them, which is much faster where files are many and small.

    ``checks`` are conditions by name that good rows fulfil.  They are counted in the write's own pass, and the result is the number
    of ``rows`` and of those that break each; ``broken_rows`` gives these rows.  With ``stopAtBroken`` the first one stops the write.
    """
    entry = find_entry(catalog, catalog_entry)
    suffix = options.pop("suffix", None)
    options = merge_options(entry, "save", options)
    options.pop("suffix", None)
    path = join_path(entry["file_path"], suffix)
    fmt = table_format(entry, path)
    if fmt in READ_ONLY_FORMATS:
        raise ValueError(f"{catalog_entry}: format {fmt!r} can only be loaded")
    rules, seen = options.pop("checks", None), None
    stops = str(options.pop("stopAtBroken", False)).lower() == "true"
    if rules:
        df, seen = observe_checks(stop_at_broken(df, rules) if stops else df, rules)
    checksums = str(options.pop("checksums", True)).lower() != "false"
    mode = options.pop("mode", "overwrite")
    partition_by = _as_list(options.pop("partitionBy", []))
    if options.pop("rebalance", False):
        df = df.hint("rebalance", *[column(name) for name in partition_by])
    if fmt == "sql":
        _write_table(df, path, mode, partition_by, options)
        return seen.get if seen else None
    if fmt == "feather":
        if partition_by:
            # A source written in Python has no partitionBy of its own: rows of a folder follow each other in each task.
            df = df.sortWithinPartitions(*[column(name) for name in partition_by])
            options, partition_by = {**options, "partitionColumns": json.dumps(partition_by)}, []
        df.sparkSession.dataSource.register(FeatherSource)
    elif fmt in TEXT_DEFAULTS:
        options = {**TEXT_DEFAULTS[fmt], **options}
        if fmt == "csv":
            options["header"] = True
            if str(merge_options(entry, "load", {}).get("multiLine", False)).lower() != "true":
                df = df.select(*[_one_line(field) for field in df.schema])
    dynamic = str(options.get("partitionOverwriteMode")).lower() == "dynamic" and partition_by
    # Feather and dynamic overwrites replace files after reading; all others delete them before.
    if mode == "overwrite" and fmt != "feather" and not dynamic:
        _refuse_own_input(df, path)
    options = options if checksums else {**options, **_NO_CHECKSUMS}
    _writer(df.write, mode, partition_by, options).format(fmt).save(path)
    return seen.get if seen else None


def publish_data(
    df: DataFrame,
    catalog: Mapping[str, Mapping],
    catalog_entry: str,
    prefix: str | None = None,
    **options: Any,
) -> str:
    """Replace the published table of an entry, decimals as doubles; returns the table's name.

    The name is the entry's, after ``prefix`` and an underscore if there is one.  The rows are written to a table of another
    name first, which takes the name over when it is whole: until then, and if the query fails, the old table
    stays.  With ``path``, each publication has a folder of its own below it.
    """
    options = merge_options(find_entry(catalog, catalog_entry), "save", options)
    partition_by = _as_list(options.pop("partitionBy", []))
    for key in ("mode", "suffix", "rebalance"):
        options.pop(key, None)
    name = f"{prefix}_{catalog_entry}" if prefix else catalog_entry
    spark, turn = df.sparkSession, uuid.uuid4().hex
    if options.get("path"):
        _refuse_own_input(df, options["path"])
        options["path"] = f"{options['path'].rstrip('/')}/published-{turn}"
    staged, old = f"{name}_staged_{turn}", f"{name}_old_{turn}"
    # A catalog in memory forgets to move the partitions of a table that is renamed: there, folders say which they are.
    key, in_memory = "spark.sql.hive.manageFilesourcePartitions", spark.conf.get("spark.sql.catalogImplementation") == "in-memory"
    managed = spark.conf.get(key)
    try:
        if in_memory:
            spark.conf.set(key, "false")
        _write_table(clean_dtypes(df), staged, "errorifexists", partition_by, options)
    except Exception:
        spark.sql(f"DROP TABLE IF EXISTS {_quoted(staged)}")
        raise
    finally:
        spark.conf.set(key, managed)
    replaced = spark.catalog.tableExists(_quoted(name))
    if replaced:
        spark.sql(f"ALTER TABLE {_quoted(name)} RENAME TO {_quoted(old)}")
    try:
        spark.sql(f"ALTER TABLE {_quoted(staged)} RENAME TO {_quoted(name)}")
    except Exception:
        if replaced:
            spark.sql(f"ALTER TABLE {_quoted(old)} RENAME TO {_quoted(name)}")
        raise
    if replaced:
        spark.sql(f"DROP TABLE {_quoted(old)}")
    return name


def _quoted(name: str) -> str:
    return ".".join(f"`{part}`" for part in name.replace("`", "").split("."))


def _one_line(field: T.StructField) -> Column:
    """The column, where a line break stops the query: without ``multiLine`` it would be read as two rows."""
    col = column(field.name)
    if not isinstance(field.dataType, T.StringType):
        return col
    message = f"{field.name} has a text with a line break; set multiLine in the load options of the entry"
    broken = col.contains("\n") | col.contains("\r")
    return F.when(broken, F.raise_error(F.lit(message)).cast("string")).otherwise(col).alias(field.name)


def _as_list(names: str | list[str]) -> list[str]:
    return [names] if isinstance(names, str) else list(names)


def _writer(
    writer: DataFrameWriter, mode: str, partition_by: list[str], options: dict
) -> DataFrameWriter:
    writer = writer.mode(mode).options(**options)
    return writer.partitionBy(*partition_by) if partition_by else writer


def _write_table(
    df: DataFrame, name: str, mode: str, partition_by: list[str], options: dict
) -> None:
    if options.get("path") and mode == "overwrite":
        _refuse_own_input(df, options["path"])
    _writer(df.write, mode, partition_by, options).saveAsTable(name)


def _refuse_own_input(df: DataFrame, path: str) -> None:
    """An overwrite deletes its target before the plan reads it: stop while the data still exists.

    Only the root paths of the plan's scans are compared, however many files are below them.
    """
    target = _one_spelling(path)
    if not _SCHEME.match(target):
        target = os.path.abspath(target)
    for root in _scanned_roots(df):
        source = _one_spelling(unquote(root))
        if not _SCHEME.match(target):
            # The target is on the default file system, whichever that is.
            source = _SCHEME.sub("", source)
        if not _SCHEME.match(source):
            source = os.path.abspath(source)
        source = _GLOB_TAIL.sub("", source)
        if f"{source}/".startswith(f"{target}/") or f"{target}/".startswith(f"{source}/"):
            raise ValueError(f"{path} is read by the table that would overwrite it")


def _scanned_roots(df: DataFrame) -> list[str]:
    """The paths that the plan's file relations and data sources were loaded with, subqueries included."""
    analyzed = df._jdf.queryExecution().analyzed()
    roots: list[str] = []
    plans = [analyzed, *_items(analyzed.subqueriesAll())]
    for leaf in [leaf for plan in plans for leaf in _items(plan.collectLeaves())]:
        kind = leaf.getClass().getSimpleName()
        if kind == "LogicalRelation" and leaf.relation().getClass().getSimpleName() == "HadoopFsRelation":
            roots += [str(path) for path in _items(leaf.relation().location().rootPaths())]
        elif kind.startswith("DataSourceV2"):
            options = leaf.options()
            roots += [options.get(key) for key in ("path",) if options.get(key)]
            roots += json.loads(options.get("paths") or "[]")
    return roots


def _items(found) -> list:
    return [found.apply(index) for index in range(found.length())]


_GLOB_TAIL = re.compile(r"/[^/]*[*?\[{].*$")
_SCHEME = re.compile(r"^[A-Za-z][A-Za-z0-9+.\-]*:(//[^/]*)?")


def _one_spelling(path: str) -> str:
    """``file:///x`` and ``file:/x`` as ``/x``; the names of the S3 connector as ``s3``."""
    path = re.sub(r"^s3[an]://", "s3://", path)
    return re.sub("^file:/+", "/", path).rstrip("/")
