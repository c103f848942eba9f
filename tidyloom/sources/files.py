"""Shared by the file formats Spark has no reader for: tasks open whole files, or pieces of them,
on shared storage and hand Arrow batches to Spark.

The driver only lists files.  Small files share a task, as in Spark's own readers; a format that can
be cut gives a large file to several tasks.
"""

from __future__ import annotations

import fnmatch
import json
import os
import re
from collections.abc import Iterable, Iterator
from urllib.parse import quote

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.pandas.types import from_arrow_schema, to_arrow_schema

# The same packing target as spark.sql.files.maxPartitionBytes, and the same cost per opened file.
PACK_BYTES = 128 * 1024 * 1024
OPEN_COST_BYTES = 4 * 1024 * 1024

Piece = tuple[str, object, int]  # path, what part of it (None for all), bytes


def open_filesystem(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path and the path inside it."""
    path = re.sub(r"^s3[an]://", "s3://", path)
    if re.match(r"^[A-Za-z][A-Za-z0-9+.\-]*://", path) and not path.startswith("file:"):
        # Paths are written out as they are; only the URI they become is encoded.
        return pafs.FileSystem.from_uri(quote(path, safe="/:@?=&"))
    return pafs.LocalFileSystem(), os.path.abspath(re.sub("^file:/+", "/", path))


def list_files(path: str) -> list[tuple[str, int]]:
    """Data files under a path, file or glob, with their sizes; hidden ones (``_x``, ``.x``) are left out."""
    fs, inner = open_filesystem(path)
    pattern = None
    if re.search(r"[*?\[]", inner):
        pattern = inner
        inner = re.split(r"/[^/]*[*?\[]", inner)[0] or "/"
    info = fs.get_file_info(inner)
    if info.type == pafs.FileType.NotFound:
        raise FileNotFoundError(path)
    if info.type == pafs.FileType.File:
        return [(info.path, info.size)]
    found = fs.get_file_info(pafs.FileSelector(inner, recursive=True))
    files = [
        (item.path, item.size)
        for item in found
        if item.type == pafs.FileType.File
        and not re.search(r"/[_.]", item.path[len(inner.rstrip("/")) :])
        and (pattern is None or _below(item.path, pattern))
    ]
    if not files:
        raise FileNotFoundError(f"no data files under {path}")
    return sorted(files)


def _below(path: str, pattern: str) -> bool:
    """Whether a path, or one of the folders it lies in, matches a glob segment by segment."""
    parts, globs = path.split("/"), pattern.rstrip("/").split("/")
    return len(parts) >= len(globs) and all(map(fnmatch.fnmatchcase, parts, globs))


def pack(pieces: Iterable[Piece], target: int = PACK_BYTES) -> list[list[Piece]]:
    """Neighbouring pieces in groups of about ``target`` bytes; every piece is in exactly one group."""
    groups: list[list[Piece]] = []
    room = 0
    for piece in pieces:
        cost = piece[2] + OPEN_COST_BYTES
        if not groups or cost > room:
            groups.append([])
            room = target
        groups[-1].append(piece)
        room -= cost
    return groups


def spark_type(dtype: pa.DataType) -> pa.DataType:
    """The nearest Arrow type that Spark has a type for."""
    if pa.types.is_dictionary(dtype):
        return spark_type(dtype.value_type)
    if pa.types.is_timestamp(dtype):
        return pa.timestamp("us", dtype.tz)
    if pa.types.is_float16(dtype):
        return pa.float32()
    if pa.types.is_null(dtype):
        return pa.string()
    widened = {
        pa.uint8(): pa.int16(),
        pa.uint16(): pa.int32(),
        pa.uint32(): pa.int64(),
        pa.uint64(): pa.decimal128(20, 0),
        pa.string_view(): pa.string(),
    }
    return widened.get(dtype, dtype)


def spark_schema(schema: pa.Schema) -> T.StructType:
    fields = [pa.field(f.name, spark_type(f.type)) for f in schema]
    return from_arrow_schema(pa.schema(fields), prefer_timestamp_ntz=True)


def conform(batch: pa.RecordBatch, schema: pa.Schema) -> pa.RecordBatch:
    """The batch with exactly the columns and types of ``schema``; columns it lacks are null."""
    places = {name: place_of(name, batch.schema.names) for name in schema.names}
    return pa.RecordBatch.from_arrays(
        [
            pa.nulls(batch.num_rows, field.type)
            if places[field.name] is None
            else _converted(batch.column(places[field.name]), field.type)
            for field in schema
        ],
        schema=schema,
    )


def place_of(name: str, names: list[str]) -> int | None:
    """Where a column is: under its own name, or under one that differs in case alone."""
    if name in names:
        return names.index(name)
    same = [i for i, other in enumerate(names) if other.lower() == name.lower()]
    if len(same) > 1:
        raise ValueError(f"{name!r} is one of several columns: {[names[i] for i in same]}")
    return same[0] if same else None


def _converted(values: pa.Array, dtype: pa.DataType) -> pa.Array:
    if values.type == dtype:
        return values
    if pa.types.is_dictionary(values.type):
        values = values.dictionary_decode()
    # Sub-microsecond digits have no place in Spark; every other loss is an error.
    return values.cast(dtype, safe=not pa.types.is_timestamp(dtype))


class FilesReader(DataSourceReader):
    """Reads the pieces of a partition one after the other, batch by batch."""

    def __init__(self, source: FilesSource, schema: T.StructType):
        self.source = source
        self.schema = schema
        self.conditions = checked_conditions(source.conditions, to_arrow_schema(schema))

    def partitions(self) -> list[InputPartition]:
        pieces = self.source.pieces(self.source.listed(self.conditions))
        return [InputPartition(group) for group in pack(pieces)]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        schema = to_arrow_schema(self.schema)
        fs, _ = open_filesystem(self.source.path)
        self.source.expected = schema.names if self.source.inferred else None
        for path, part, _ in partition.value:
            for batch in self.source.batches(fs, path, part, schema.names):
                yield selected(conform(batch, schema), self.conditions)


def _is_plain(dtype: pa.DataType) -> bool:
    """Types that Arrow and Spark compare alike: floating-point numbers (NaN) and times with a zone are not among them."""
    zoned = pa.types.is_timestamp(dtype) and dtype.tz is not None
    kinds = (pa.types.is_integer, pa.types.is_string, pa.types.is_boolean, pa.types.is_date, pa.types.is_decimal, pa.types.is_timestamp)
    return not zoned and any(kind(dtype) for kind in kinds)


def _given(value: str, dtype: pa.DataType) -> pa.Scalar:
    return pa.scalar(value, pa.string()).cast(dtype)


#: What a condition does to a column; values come as text.
TESTS = {
    "=": lambda x, v: pc.equal(x, _given(v, x.type)),
    ">": lambda x, v: pc.greater(x, _given(v, x.type)),
    ">=": lambda x, v: pc.greater_equal(x, _given(v, x.type)),
    "<": lambda x, v: pc.less(x, _given(v, x.type)),
    "<=": lambda x, v: pc.less_equal(x, _given(v, x.type)),
    "in": lambda x, v: pc.and_(pc.is_in(x, value_set=pa.array(v, pa.string()).cast(x.type)), pc.is_valid(x)),
    "is null": lambda x, v: pc.is_null(x),
    "is not null": lambda x, v: pc.is_valid(x),
}

#: Column, test and value (a list for ``in``, nothing for the last two).
Condition = tuple[str, str, object]


def checked_conditions(conditions: list[Condition], schema: pa.Schema) -> list[Condition]:
    for name, test, _ in conditions:
        if name not in schema.names or test not in TESTS:
            raise ValueError(f"a condition needs a column of the table and one of {sorted(TESTS)}, not {name!r} and {test!r}")
        if not _is_plain(schema.field(name).type):
            raise ValueError(f"{name}: conditions on columns of type {schema.field(name).type} are left to filters of the table")
    return conditions


def selected(batch: pa.RecordBatch, conditions: list[Condition]) -> pa.RecordBatch:
    """The rows for which all conditions are true; one on a column that the batch lacks says nothing."""
    for name, test, value in conditions:
        if name in batch.schema.names:
            batch = batch.filter(TESTS[test](batch.column(name), value))
    return batch


class FilesSource(DataSource):
    """Base of the formats; a format says how to read a schema and the batches of one piece."""

    #: Whether the columns were taken from the first file, not declared.
    inferred = False
    #: The columns that a file may have; None if any.
    expected: list[str] | None = None

    def refuse_unknown(self, names: list[str], path: str) -> None:
        """For the formats, once a file is open."""
        unknown = [] if self.expected is None else [name for name in names if place_of(name, self.expected) is None]
        if unknown:
            raise ValueError(f"{path} has columns that the first file lacks: {unknown}; declare a schema, or columns")

    @property
    def path(self) -> str:
        if "path" not in self.options:
            raise ValueError(f"format {self.name()!r} needs a path")
        return self.options["path"]

    def schema(self) -> T.StructType:
        """Taken from the first file; a file with other columns as well stops the query.  Declare a schema then."""
        self.inferred = True
        fs, _ = open_filesystem(self.path)
        return spark_schema(self.file_schema(fs, list_files(self.path)[0][0]))

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return FilesReader(self, schema)

    @property
    def conditions(self) -> list[Condition]:
        """Of the option ``where``: rows that fail one do not leave the task, and files of which none can pass are not opened."""
        return [tuple(x) for x in json.loads(self.options.get("where", "[]"))]

    def listed(self, conditions: list[Condition]) -> list[tuple]:
        """The data files, each with its path and size first; ``conditions`` may leave some out."""
        return list_files(self.path)

    def pieces(self, files: list[tuple]) -> Iterable[Piece]:
        return [(path, None, size) for path, size, *_ in files]

    def file_schema(self, fs: pafs.FileSystem, path: str) -> pa.Schema:
        raise NotImplementedError

    def batches(
        self, fs: pafs.FileSystem, path: str, part: object, columns: list[str]
    ) -> Iterator[pa.RecordBatch]:
        raise NotImplementedError
