"""Loading tables by entry: every format becomes one lazy ``DataFrame``."""

from __future__ import annotations

import functools
import json
import operator
from collections.abc import Callable, Iterator, Mapping
from typing import Any

import pyarrow as pa
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..catalog import find_entry, join_path, merge_options, table_format
from ..functions.keys import column
from ..operators.checks import stop_at_broken
from ..operators.inference import infer_types
from .feather import FeatherSource
from .files import FilesSource
from .fixed_width import read_fixed_width
from .html import html_tables
from .ranges import RANGE_BYTES, can_split, split_csv, split_json

FILE_SOURCES: dict[str, type[FilesSource]] = {FeatherSource.name(): FeatherSource}


def load_data(
    spark: SparkSession, catalog: Mapping[str, Mapping], catalog_entry: str, **options: Any
) -> DataFrame:
    """The table behind an entry.

    Call options win over the entry's ``load`` options.  Besides the options of the format's reader:
    ``suffix`` (a file or folder under the entry's path), ``schema`` (DDL text or a ``StructType``),
    ``columns`` (read only these), ``where`` (conditions ``(column, test, value)`` on columns, all of which hold; the test is one of ``=``,
    ``>``, ``>=``, ``<``, ``<=``, ``in``, ``is null`` and ``is not null``), ``inferTypes`` (text columns get the types that all of their values fit, by a pass over the
    table) and ``checks`` (conditions by name; a row that breaks one stops the query).
    """
    entry = find_entry(catalog, catalog_entry)
    options = merge_options(entry, "load", options)
    path = join_path(entry["file_path"], options.pop("suffix", None))
    fmt = table_format(entry, path)
    columns = options.pop("columns", None)
    rules, infer = options.pop("checks", None), str(options.pop("inferTypes", False)).lower() == "true"
    where = options.get("where", []) if fmt in FILE_SOURCES else options.pop("where", [])
    if where and fmt not in FILE_SOURCES:
        # Spark's own readers take filters from the plan.
        df = _loaded(spark, fmt, path, None, options).filter(functools.reduce(operator.and_, map(_filter, where)))
        df = df.select(*[column(name) for name in columns]) if columns else df
    else:
        df = _loaded(spark, fmt, path, columns, options)
    if infer:
        df = infer_types(df)
    return stop_at_broken(df, rules) if rules else df


def _loaded(spark: SparkSession, fmt: str, path: str, columns: list[str] | None, options: dict) -> DataFrame:
    if fmt in FILE_SOURCES:
        return _load_file_source(spark, fmt, path, columns, options)
    df = _LOADERS.get(fmt, _load_spark)(spark, fmt, path, options)
    return df.select(*[column(name) for name in columns]) if columns else df


def load_inputs(
    spark: SparkSession,
    catalog: Mapping[str, Mapping],
    input_filenames: Mapping[str, str | None],
    **options: Any,
) -> dict[str, DataFrame]:
    """Several entries at once: ``{entry: file name under it, or None for all of it}``."""
    return {
        name: load_data(spark, catalog, name, suffix=filename, **options)
        for name, filename in input_filenames.items()
    }


def register_file_sources(spark: SparkSession) -> None:
    """Make ``spark.read.format("feather")`` known to the session."""
    for source in FILE_SOURCES.values():
        spark.dataSource.register(source)


def _as_texts(condition: tuple) -> tuple:
    """A condition with its values as text; a null is equal to nothing."""
    name, test, value = (*condition, None)[:3]
    if test == "in":
        return name, test, [_text(v) for v in value if v is not None]
    return name, test, None if value is None else _text(value)


def _text(value: Any) -> str:
    return str(value).lower() if isinstance(value, bool) else str(value)


def _filter(condition: tuple) -> Column:
    name, test, value = (*condition, None)[:3]
    col = column(name)
    tests = {
        "=": lambda: col == value,
        ">": lambda: col > value,
        ">=": lambda: col >= value,
        "<": lambda: col < value,
        "<=": lambda: col <= value,
        "in": lambda: col.isin([v for v in value if v is not None]),
        "is null": col.isNull,
        "is not null": col.isNotNull,
    }
    if test not in tests:
        raise ValueError(f"a condition needs one of {sorted(tests)}, not {test!r}")
    return tests[test]()


def _load_spark(spark: SparkSession, fmt: str, path: str, options: dict) -> DataFrame:
    reader = spark.read.format(fmt)
    if "schema" in options:
        reader = reader.schema(options.pop("schema"))
    reader = reader.options(**options)
    # Sources such as jdbc take everything from their options.
    return reader.load(path) if path else reader.load()


def _load_csv(spark: SparkSession, fmt: str, path: str, options: dict) -> DataFrame:
    """With ``multiLine`` a large file is cut between records by several tasks.

    A quote then begins a field or belongs to one that it began, and lines end in ``\\n`` or ``\\r\\n``; set ``splittable`` to false for
    other files, which Spark reads one a task.
    """
    # A quote within a quoted text is doubled, as other programs write it.
    defaults = {"header": True, "escape": '"'} | ({} if fmt == "csv" else {"sep": "\t"})
    options = {**defaults, **options}
    splitting = _pop_splitting(options)
    df = _load_spark(spark, "csv", path, dict(options))
    separator = str(options.get("sep") or options.get("delimiter") or ",")
    plain = len(separator.encode()) == 1 and options["escape"] == options.get("quote", '"') == '"'
    other = {"comment", "lineSep", "charToEscapeQuoteEscaping", "inferSchema"} & set(options)
    lenient = str(options.get("mode", "")).upper() == "DROPMALFORMED"
    if str(options.get("multiLine")).lower() != "true" or not plain or other or lenient or not can_split(spark, path, options | splitting):
        return df
    header = str(options["header"]).lower() == "true"
    rows = split_csv(spark, path, options, header, separator, splitting["range_bytes"])
    if rows is None:
        return df
    parser = {k: v for k, v in options.items() if k not in ("schema", "header", "multiLine")}
    return _parsed(rows, df.schema, lambda schema: F.from_csv("value", _ddl(schema), parser))


def _load_json(spark: SparkSession, fmt: str, path: str, options: dict) -> DataFrame:
    """Documents, one a file, unless the entry says ``multiLine`` is false: then a document a line.

    A document that is an array has a row per element, and a large one is cut between them by several tasks; it is strict JSON.  Set
    ``splittable`` to false for other files, which Spark reads one a task.  Nothing is guessed from the files but, without a
    schema, the types.  A line that is no document stops the query, and so does a file with something after its document.
    """
    splitting = _pop_splitting(options)
    if str(options.get("multiLine", True)).lower() == "false":
        return _load_spark(spark, "json", path, {"mode": "FAILFAST", **options})
    df = _load_spark(spark, "json", path, {**options, "multiLine": True})
    lenient = {"allowComments", "allowSingleQuotes", "allowUnquotedFieldNames", "lineSep"} & set(options)
    dropping = str(options.get("mode", "")).upper() == "DROPMALFORMED"
    if not lenient and not dropping and can_split(spark, path, options | splitting):
        rows = split_json(spark, path, options, splitting["range_bytes"])
        if rows is not None:
            parser = {k: str(v) for k, v in options.items() if k not in ("schema", "multiLine")}
            return _parsed(rows, df.schema, lambda schema: F.from_json("value", schema, parser))
    layout = {k: v for k, v in options.items() if k in ("pathGlobFilter", "recursiveFileLookup", "modifiedBefore", "modifiedAfter")}
    files = spark.read.options(**layout).format("binaryFile").load(path).select("path", "content")
    encoding = options.get("encoding") or options.get("charset")
    return df.unionByName(files.mapInArrow(_single_documents(encoding), df.schema))


def _pop_splitting(options: dict) -> dict:
    """The options about cutting files; they are no reader's."""
    return {"splittable": options.pop("splittable", True), "range_bytes": int(options.pop("rangeBytes", RANGE_BYTES))}


def _parsed(rows: DataFrame, schema: T.StructType, parse: Callable[[T.StructType], Column]) -> DataFrame:
    """The fields of each row's ``value``, then the columns of partition folders, as ``schema`` has them."""
    folders = [name for name in rows.columns if name != "value"]
    inner = T.StructType([field for field in schema if field.name not in folders])
    parsed = rows.select(parse(inner).alias("record"), *[column(name) for name in folders])
    return parsed.select(*[column(f.name) if f.name in folders else F.col("record")[f.name].alias(f.name) for f in schema])


def _ddl(schema: T.StructType) -> str:
    names = [(field.name.replace("`", "``"), field.dataType.simpleString()) for field in schema]
    return ", ".join(f"`{name}` {kind}" for name, kind in names)


def _single_documents(encoding: str | None) -> Callable:
    """A part of the scan's own plan that has no rows and stops at a file with several documents."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = json.JSONDecoder()
        for batch in batches:
            for path, content in zip(batch.column("path"), batch.column("content")):
                data = content.as_py()
                text = data.decode(encoding or json.detect_encoding(data), "replace").lstrip("\ufeff \t\r\n")
                try:
                    end = decoder.raw_decode(text)[1] if text else 0
                except (ValueError, RecursionError):
                    continue  # the reader decides about what is not strict JSON
                if text[end:].strip():
                    raise ValueError(f"{path}: something follows the document; for a document a line set multiLine to false")
        yield from ()

    return check


def _load_xml(spark: SparkSession, fmt: str, path: str, options: dict) -> DataFrame:
    return _load_spark(spark, fmt, path, {"ignoreSurroundingSpaces": False, **options})


def _load_fixed_width(spark: SparkSession, fmt: str, path: str, options: dict) -> DataFrame:
    return read_fixed_width(spark, path, **options)


def _load_html(spark: SparkSession, fmt: str, path: str, options: dict) -> DataFrame:
    """``file_path, table_no, row_no, cells``, and the columns of partition folders; other folders are read all the way down."""
    more = {"most_span": int(options.pop("mostSpan"))} if "mostSpan" in options else {}
    try:
        pages = spark.read.options(**options).text(path, wholetext=True)
    except PySparkException as error:
        if "CONFLICTING" not in str(error):
            raise
        pages = None
    if pages is None or len(pages.columns) == 1:
        pages = spark.read.options(**{"recursiveFileLookup": True, **options}).text(path, wholetext=True)
    folders = [name for name in pages.columns if name != "value"]
    pages = pages.select(F.col("_metadata.file_path").alias("file_path"), F.col("value"), *map(column, folders))
    tables = html_tables(pages, "value", "file_path", *[f"`{name}`" for name in folders], **more)
    return tables.select("file_path", "table_no", "row_no", "cells", *map(column, folders))


def _load_sql(spark: SparkSession, fmt: str, path: str, options: dict) -> DataFrame:
    """``path`` is a table name or a query over the session's tables; ``params`` fills its markers."""
    if "con" in options:
        raise ValueError("tables of another database are loaded with the format 'jdbc'")
    is_query = fmt == "sql_query" or (fmt == "sql" and len(path.split()) > 1)
    if is_query:
        return spark.sql(path, args=options.get("params"))
    return spark.table(path)


def _load_file_source(
    spark: SparkSession, fmt: str, path: str, columns: list[str] | None, options: dict
) -> DataFrame:
    spark.dataSource.register(FILE_SOURCES[fmt])
    schema = options.pop("schema", None)
    where = options.pop("where", [])
    options["where"] = json.dumps([_as_texts(condition) for condition in where])
    reader = spark.read.format(fmt).options(**options)
    if columns and schema is None:
        # Declaring only the wanted columns keeps the others from being read.
        full = reader.load(path).schema
        schema = T.StructType([full[name] for name in dict.fromkeys([*columns, *(name for name, *_ in where)])])
    if schema is not None:
        reader = reader.schema(schema)
    df = reader.load(path)
    return df.select(*[column(name) for name in columns]) if columns else df


_LOADERS: dict[str, Callable[[SparkSession, str, str, dict], DataFrame]] = {
    "csv": _load_csv,
    "table": _load_csv,
    "xml": _load_xml,
    "json": _load_json,
    "fwf": _load_fixed_width,
    "html": _load_html,
    "sql": _load_sql,
    "sql_query": _load_sql,
    "sql_table": _load_sql,
}
